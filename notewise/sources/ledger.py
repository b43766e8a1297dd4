"""Reading and writing the instalment ledger.

The ledger file has one row per scheduled instalment and 19 titled columns (see
``schema.LEDGER_TITLES``). It is read by Spark's own distributed readers as text, columns are
found by title and parsed by native expressions, and no bad field becomes null unseen.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.sources.schema import LEDGER_TITLES, ledger_schema, title_map

CORRUPT = "_corrupt_record"
DATE_FORMAT = "yyyy-MM-dd"
_INFERRED_DATES = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")  # how inferred dates and times print


def normalise_titles(df: DataFrame) -> DataFrame:
    """Rename CSV titles to ledger column names; columns keep their order.

    Titles that are not ledger titles (e.g. ``_corrupt_record``) pass through unchanged.
    """
    names = title_map()
    return df.select([F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def to_titles(df: DataFrame) -> DataFrame:
    """Inverse of ``normalise_titles``: ledger column names back to the CSV titles."""
    back = {v: k for k, v in title_map().items()}
    return df.select([F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns])


def parse_ledger(raw: DataFrame, date_formats: Sequence[str] = (DATE_FORMAT,), on_bad: str = "fail") -> DataFrame:
    """Ledger columns from text columns named by title (or by ledger name).

    A field that is not empty and does not fit its type is bad; so is a row that the file
    reader set aside in ``_corrupt_record`` (too few or too many fields). ``on_bad``:

    * ``fail`` (default): the job fails and names the fields of the row;
    * ``keep``: bad fields are null and ``_corrupt_record`` says which they were, null for
      good rows (see ``quality.dq_corrupt_rows`` and ``quality.dq_corrupt_report``);
    * ``null``: bad fields are null and no trace is kept.

    A date fits the first of ``date_formats`` that reads it.
    """
    if on_bad not in ("fail", "keep", "null"):
        raise ValueError(f"on_bad={on_bad!r}: use fail, keep or null")
    df = normalise_titles(raw)
    missing = [f.name for f in ledger_schema().fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"the ledger lacks the columns {', '.join(missing)}")
    typed, doubtful = {}, []
    for field in ledger_schema().fields:
        text = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            read = [F.try_to_timestamp(text.cast("string"), F.lit(f)).cast("date") for f in date_formats]
            value = text if df.schema[field.name].dataType == field.dataType else F.coalesce(*read)
        elif isinstance(field.dataType, T.StringType):
            value = text.cast("string")
        else:
            value = text.try_cast(field.dataType)
        typed[field.name] = value
        if not isinstance(field.dataType, T.StringType):  # text always fits
            doubtful.append(field.name)
    columns = [c.alias(n) for n, c in typed.items()]
    if on_bad == "null":
        return df.select(*columns)
    # Every field is parsed once; its text goes along for the trace, which only bad rows build.
    own = [F.col(f"`{CORRUPT}`").alias("_own")] if CORRUPT in df.columns else []
    parsed = df.select(*columns, *[F.col(f"`{n}`").cast("string").alias(f"_text_{n}") for n in doubtful], *own)
    bad = {n: F.col(n).isNull() & (F.coalesce(F.trim(f"_text_{n}"), F.lit("")) != "") for n in doubtful}
    any_bad = reduce(Column.__or__, [*bad.values(), *([F.col("_own").isNotNull()] if own else [])])
    # concat_ws passes over nulls; an array function with a lambda here would run every row interpreted.
    trace = F.when(any_bad, F.concat_ws(
        "; ", *[F.when(c, F.concat(F.lit(n + "="), F.col(f"_text_{n}"))) for n, c in bad.items()], *([F.col("_own")] if own else [])))
    # One generated row per row: its columns are plain to the optimizer, which would otherwise
    # carry the check's expression through every constraint of the columns that it shares.
    parsed = parsed.select(F.inline(F.array(F.struct(*typed, trace.alias(CORRUPT)))))
    if on_bad == "keep":
        return parsed
    failed = F.raise_error(F.concat(F.lit("the ledger has a bad row: "), F.col(CORRUPT))).cast("boolean")
    return parsed.where(F.when(F.col(CORRUPT).isNotNull(), failed).otherwise(F.lit(True))).drop(CORRUPT)


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All columns as text, with a place for rows of the wrong shape."""
    return T.StructType([T.StructField(c, T.StringType()) for c in (*columns, CORRUPT)])


def csv_options(multi_line: bool = False) -> dict:
    """The dialect of the ledger file: doubled quotes inside quoted fields. ``multi_line``
    also allows line breaks there, at the price of one task per file."""
    return {"header": True, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": multi_line,
            "columnNameOfCorruptRecord": CORRUPT, "enforceSchema": False}


def read_ledger(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    date_format: str | Sequence[str] = DATE_FORMAT,
    infer_schema: bool = False,
    keep_corrupt: bool = False,
    on_bad: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read a ledger and return it with normalised column names and the ledger's types.

    * ``csv``: columns are found by the titles in the header, in any order (all files in the
      same order; a file that differs fails the job); a missing title is an error. Doubled
      quotes are read as one; line breaks inside quotes need ``multi_line``. An empty
      ``Date Paid`` is null, i.e. unpaid. ``date_format`` may list several formats.
      Bad rows: see ``parse_ledger``; ``keep_corrupt`` is ``on_bad="keep"``.
      ``infer_schema`` lets Spark find the types and then casts them to the ledger's.
    * ``json``: one object per line, fields by title or ledger name, parsed like CSV.
    * ``parquet`` / ``orc``: files that already carry the titles or the normalised names;
      cast to the ledger schema.
    * ``table``: a catalog table name.
    """
    formats = (date_format,) if isinstance(date_format, str) else tuple(date_format)
    bad = on_bad or ("keep" if keep_corrupt else "fail")
    if fmt == "csv":
        reader = spark.read.options(**csv_options(multi_line))
        if infer_schema:
            raw = reader.option("inferSchema", True).option("dateFormat", formats[0]).csv(path)
            return parse_ledger(raw, (*formats, *_INFERRED_DATES), bad)
        header = spark.read.options(**csv_options(multi_line)).csv(path).columns
        return parse_ledger(reader.schema(text_schema(header)).csv(path), formats, bad)
    if fmt == "json":
        # Titles and ledger names differ in case only for some columns, so the fields of a
        # line are taken from a map, not from a schema.
        line = spark.read.text(path).select("value", F.from_json("value", "map<string,string>").alias("m"))
        found = [F.coalesce(F.col("m")[t], F.col("m")[c]).alias(c) for t, c in title_map().items()]
        broken = F.when(F.col("m").isNull(), F.col("value")).alias(CORRUPT)
        return parse_ledger(line.select(*found, broken), formats, bad)
    raw = spark.read.table(path) if fmt == "table" else spark.read.format(fmt).load(path)
    df = normalise_titles(raw)
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in ledger_schema().fields])


def write_ledger(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "error",
    titles: bool = False,
    partition_by: list[str] | None = None,
) -> None:
    """Write a ledger with any Spark sink (CSV gets a header and the original titles)."""
    out = to_titles(df) if (titles or fmt == "csv") else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, dateFormat=DATE_FORMAT, quote='"', escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


__all__ = ["read_ledger", "write_ledger", "normalise_titles", "to_titles", "LEDGER_TITLES"]
