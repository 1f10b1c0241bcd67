"""Order dates: text in, calendar parts out. Bad text gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_DATE = r"\A\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?\z"
_DAY_FIRST = r"\A\d{2}/\d{2}/\d{4}\z"


def iso_date(text: Column) -> Column:
    """DATE of ISO date or datetime text; null for every other shape."""
    day = F.when(text.rlike(_ISO_DATE), F.substring(text, 1, 10))
    return F.try_to_date(day, "yyyy-MM-dd")


def any_date(text: Column) -> Column:
    """DATE of ISO or DD/MM/YYYY text."""
    day_first = F.when(text.rlike(_DAY_FIRST), text)
    return F.coalesce(iso_date(text), F.try_to_date(day_first, "dd/MM/yyyy"))


def quarter_label(month: Column) -> Column:
    """Q1..Q4 of a month number. A missing month falls through to Q4."""
    return (
        F.when(month.between(1, 3), "Q1")
        .when(month.between(4, 6), "Q2")
        .when(month.between(7, 9), "Q3")
        .otherwise("Q4")
    )
