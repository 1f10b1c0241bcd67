"""DataFrame -> DataFrame operators: typing, profiling, cleaning, sampling."""
