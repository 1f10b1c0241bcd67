"""CSV at the outer edges: every column read as text, written text left untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.functions.text import null_if_na


def files_with_quoted_newlines(spark: SparkSession, path: str) -> list[str]:
    """The files in which some record spans several lines.

    Quotes inside a field are doubled, so a record that ends on its own line
    holds an even number of quotes. One splittable text scan settles it.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    odd = lines.where(quotes % 2 == 1).select(lines.metadataColumn("_metadata")["file_path"].alias("file")).distinct()
    return [r.file for r in odd.collect()]


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Read CSV files with a header; missing-value tokens become null.

    A multi-line read cannot split a file, so only the files that need it are read that way; ``None``
    finds them with a text scan. The others stay splittable.
    """
    whole = files_with_quoted_newlines(spark, path) if multi_line is None else []
    several = bool(whole) or bool(multi_line)
    names = _reader(spark, several).csv(path).columns
    if not names:
        return _reader(spark, several).csv(path)
    if not whole:
        records = _whole_records(_reader(spark, several), path, names)
    else:
        records = _whole_records(_reader(spark, False), path, names, whole, False).unionByName(
            _whole_records(_reader(spark, True), path, names, whole, True)
        )
    return records.select([null_if_na(F.col(f"`{c}`")).alias(c) for c in names])


def _reader(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def _whole_records(reader: DataFrameReader, path: str, names: list[str], files: list[str] | None = None, among: bool = True) -> DataFrame:
    """The records as text columns; one with more fields than the header stops the query.

    With ``files`` those among them, or all others: Spark leaves out the rest before it reads. It
    marks records whose length is not the header's. Only those are parsed once more, with a
    column for a field beyond the header. Shorter ones end in nulls.
    """
    mark = "_odd_record"
    while mark in (n.lower() for n in names):
        mark = f"_{mark}"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, mark]])
    text = (
        reader.schema(schema).option("columnNameOfCorruptRecord", mark).option("columnPruning", False).csv(path)
    )
    if files is not None:
        listed = text.metadataColumn("_metadata")["file_path"].isin(files)
        text = text.where(listed if among else ~listed)
    places = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    beyond = F.from_csv(F.col(mark), places, {"escape": '"', "multiLine": "true"})[f"c{len(names)}"].isNotNull()
    message = F.concat(F.lit("a record has more fields than the header: "), F.col(mark), F.coalesce(F.left(F.col(f"`{names[0]}`"), F.lit(0)), F.lit("")))
    stop = F.when(F.col(mark).isNotNull() & beyond, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return text.where(stop)


def write_csv(df: DataFrame, path: str) -> None:
    """Write one file per partition, keeping outer spaces and doubling quotes."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
