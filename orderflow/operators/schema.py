"""Column names and types: standardising, inference, report, typing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.fixed_values import EXPECTED_TYPES
from orderflow.functions.text import header_name
from orderflow.sources.counted import TOTALS

_SPARK_TYPE = {"int64": T.LongType(), "float64": T.DoubleType(), "object": T.StringType()}

ORDER_COLUMNS = tuple(EXPECTED_TYPES)
ORDER_SCHEMA = T.StructType([T.StructField(c, _SPARK_TYPE[t]) for c, t in EXPECTED_TYPES.items()])

_LARGEST_UNSIGNED = Decimal(2**64 - 1)
_INTEGER_TEXT = r"\A\s*[+-]?\d+\s*\z"
_NUMBER_TEXT = r"(?i)\A\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*\z"
_BOOLEAN_TEXT = r"\A(True|TRUE|true|False|FALSE|false)\z"


def standardize_columns(df: DataFrame, column_map: Mapping[str, str] | None = None) -> DataFrame:
    """Rename by map, then turn every header into a plain identifier."""
    renamed = df.withColumnsRenamed(dict(column_map or {}))
    return renamed.toDF(*[header_name(c) for c in renamed.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value."""
    floats = {
        f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


# Kinds of cells, one bit each, so a column is described by the kinds it holds.
_NULL, _INTEGER, _NEGATIVE, _UNSIGNED, _LONGER, _NUMBER, _BOOLEAN, _TEXT = (1 << i for i in range(8))
_WHOLE = _INTEGER | _NEGATIVE | _UNSIGNED | _LONGER


def _cell_kind(field: T.StructField) -> Column:
    """The kind of one cell. Most text is settled by the first pattern's first character."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        kind = F.lit(_INTEGER)
    elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        kind = F.lit(_NUMBER)
    elif isinstance(field.dataType, T.BooleanType):
        kind = F.lit(_BOOLEAN)
    elif isinstance(field.dataType, T.StringType):
        integer = value.try_cast("bigint")
        boolean = F.length(value).isin(4, 5) & value.rlike(_BOOLEAN_TEXT)
        kind = (
            F.when(~value.rlike(_NUMBER_TEXT), F.when(boolean, _BOOLEAN).otherwise(_TEXT))
            .when(~value.rlike(_INTEGER_TEXT), _NUMBER)
            .when(integer.isNotNull(), F.when(integer < 0, _NEGATIVE).otherwise(_INTEGER))
            .when(value.try_cast("decimal(38,0)").between(0, _LARGEST_UNSIGNED), _UNSIGNED)
            .otherwise(_LONGER)
        )
    else:
        kind = F.lit(_TEXT)
    return F.when(value.isNull(), _NULL).otherwise(kind)


def _type_of(kinds: Column) -> Column:
    """The narrowest type that holds all kinds of a column; null kinds: no rows."""

    def only(allowed: int) -> Column:
        return kinds.bitwiseAND(~allowed) == 0

    beyond_integer = kinds.bitwiseAND(_UNSIGNED | _LONGER) != 0
    return (
        F.when(kinds.isNull(), "object")
        .when(kinds == _NULL, "float64")
        .when(only(_INTEGER | _NEGATIVE), "int64")
        .when(only(_INTEGER | _UNSIGNED), "uint64")
        .when(only(_WHOLE | _NULL) & beyond_integer, "object")
        .when(only(_WHOLE | _NUMBER | _NULL), "float64")
        .when(kinds == _BOOLEAN, "bool")
        .otherwise("object")
    )


def inferred_types(df: DataFrame) -> DataFrame:
    """(column, inferred_type) for every column: one scan, one small aggregate."""
    kinds = df.select([_cell_kind(f).alias(f.name) for f in df.schema])
    one_row = kinds.agg(*[F.bit_or(f"`{c}`").alias(c) for c in df.columns])
    named = one_row.select([_type_of(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return named.unpivot([], list(df.columns), "column", "inferred_type")


def missing_columns(df: DataFrame, expected: Mapping[str, str] = EXPECTED_TYPES) -> list[str]:
    return [c for c in expected if c not in df.columns]


def require_columns(df: DataFrame, expected: Mapping[str, str] = EXPECTED_TYPES) -> None:
    """Stop before any job runs when a required column is absent."""
    missing = missing_columns(df, expected)
    if missing:
        raise ValueError(f"the orders lack the columns {missing}; they have {df.columns}")


def schema_report(df: DataFrame, expected: Mapping[str, str] = EXPECTED_TYPES) -> DataFrame:
    """(column, expected, actual) for absent columns and for type mismatches."""
    wanted = F.create_map(*[F.lit(x) for item in expected.items() for x in item])
    present = df.select([F.col(c) for c in expected if c in df.columns])
    actual = inferred_types(present).select(
        "column", wanted[F.col("column")].alias("expected"), F.col("inferred_type").alias("actual")
    )
    absent = [(c, expected[c], "missing") for c in missing_columns(df, expected)]
    report = actual.where("expected != actual")
    if absent:
        spark = df.sparkSession
        report = report.unionByName(spark.createDataFrame(absent, "column string, expected string, actual string"))
    return report


def _plain_number(text: Column) -> Column:
    """DOUBLE of text that is a number as files write it; a cast alone would read ``3d`` as 3."""
    return F.when(text.rlike(_NUMBER_TEXT), text.try_cast("double"))


def _whole_number(text: Column) -> Column:
    """BIGINT of text such as 2, 2.0 or 2e3; null for a fraction."""
    number = text.try_cast("decimal(38,10)")
    whole = F.when(number == F.floor(number), number).try_cast("bigint")
    return F.coalesce(text.try_cast("bigint"), whole)


#: Columns that name things: they keep whatever text they hold.
ID_COLUMNS = ("order_id", "customer_id", "product_id")


class UnreadableValues(ValueError):
    """A column of measures holds text that is no number."""


def text_ids(mismatches: Iterable[Mapping[str, str]]) -> list[str]:
    """The id columns of a schema report that hold text."""
    return [m["column"] for m in mismatches if m["column"] in ID_COLUMNS and m["actual"] == "object"]


def cell_findings(df: DataFrame, expected: Mapping[str, str] = EXPECTED_TYPES) -> dict[str, tuple[str, Column]]:
    """What each row adds to the findings: the kind of each cell, unreadable numbers, fractions.

    The names are ``kind:``, ``unread:`` or ``fraction:`` and a column; with each goes how rows are put together.
    """
    cells = {}
    for field in df.schema:
        wanted = expected.get(field.name)
        if wanted is None:
            continue
        text = F.col(field.name)
        cells[f"kind:{field.name}"] = ("bits", _cell_kind(field))
        if wanted == "object" or not isinstance(field.dataType, T.StringType):
            continue
        number = _plain_number(text)
        if field.name not in ID_COLUMNS:
            cells[f"unread:{field.name}"] = ("sum", F.when(text.isNotNull() & number.isNull(), 1).otherwise(0))
        if wanted == "int64":
            cells[f"fraction:{field.name}"] = ("sum", F.when(number.isNotNull() & _whole_number(text).isNull(), 1).otherwise(0))
    return cells


def findings(df: DataFrame, expected: Mapping[str, str] = EXPECTED_TYPES) -> dict[str, int | None]:
    """The findings of a table, by one scan."""
    cells = cell_findings(df, expected)
    named = df.select([cell.alias(name) for name, (_, cell) in cells.items()])
    return named.agg(*[TOTALS[kind](F.col(f"`{name}`")).alias(name) for name, (kind, _) in cells.items()]).first().asDict()


def found_types(spark: SparkSession, found: Mapping[str, int | None], expected: Mapping[str, str] = EXPECTED_TYPES) -> DataFrame:
    """(column, expected, actual): the schema report of a table by its findings."""
    rows = [(c, t, f"kind:{c}" in found, found.get(f"kind:{c}")) for c, t in expected.items()]
    report = spark.createDataFrame(rows, "column string, expected string, present boolean, kinds int")
    actual = F.when(F.col("present"), _type_of(F.col("kinds"))).otherwise("missing").alias("actual")
    return report.select("column", "expected", actual).where("expected != actual")


def require_numbers(found: Mapping[str, int | None]) -> None:
    """Stop, naming columns and counts, where numbers are expected and some text is none."""
    unread = {name.removeprefix("unread:"): n for name, n in found.items() if name.startswith("unread:") and n}
    if unread:
        raise UnreadableValues(f"values that are no numbers, by column: {unread}")


def fractional_columns(found: Mapping[str, int | None], mismatches: Iterable[Mapping[str, str]]) -> list[str]:
    """The text columns in which some number is not whole although whole ones are expected."""
    float_instead = [m["column"] for m in mismatches if (m["expected"], m["actual"]) == ("int64", "float64")]
    return [c for c in float_instead if found.get(f"fraction:{c}")]


def column_states(tables: Mapping[str, DataFrame], expected: Mapping[str, str] = EXPECTED_TYPES) -> DataFrame:
    """(table, column, state, rows): each expected column present or missing, others unexpected."""
    found = None
    for name, df in tables.items():
        states = [(c, "present" if c in df.columns else "missing") for c in expected]
        states += [(c, "unexpected") for c in df.columns if c not in expected]
        listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(state).alias("state")) for c, state in states])
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.inline(listed), "rows")
        found = one if found is None else found.unionByName(one)
    return found.select("table", "column", "state", "rows")


def with_required_columns(df: DataFrame, expected: Mapping[str, str] = EXPECTED_TYPES) -> DataFrame:
    """``df`` whose own job stops, with the names, when a required column is absent."""
    missing = missing_columns(df, expected)
    if not missing:
        return df
    message = f"the orders lack the columns {missing}; they have {df.columns}"
    return df.where(F.raise_error(F.concat(F.lit(message), F.left(F.col(f"`{df.columns[0]}`").cast("string"), F.lit(0)))).cast("boolean"))


def with_order_types(
    df: DataFrame, as_double: Iterable[str] = (), as_text: Iterable[str] = ()
) -> DataFrame:
    """Give text columns their expected types.

    Columns in ``as_double`` hold fractions where whole numbers are expected, those in ``as_text`` are
    ids that stay text. Elsewhere text that does not parse becomes null: see ``require_numbers``.
    """
    fractions, kept = set(as_double), set(as_text)
    typed = {}
    for field in ORDER_SCHEMA:
        actual = df.schema[field.name].dataType
        column = F.col(field.name)
        if actual == field.dataType or field.name in kept:
            continue
        if field.name in fractions:
            typed[field.name] = _plain_number(column)
        elif isinstance(actual, T.StringType) and isinstance(field.dataType, T.LongType):
            typed[field.name] = _whole_number(column)
        elif isinstance(actual, T.StringType) and isinstance(field.dataType, T.DoubleType):
            typed[field.name] = _plain_number(column)
        else:
            typed[field.name] = column.try_cast(field.dataType)
    return df.withColumns(typed) if typed else df
