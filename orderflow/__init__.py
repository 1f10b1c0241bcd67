"""Order quality, warehouse and lineage jobs written as Spark DataFrame plans."""
