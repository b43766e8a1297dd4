"""A folder of ledger files whose headers differ.

Exports of several years put their columns in different orders, add some and lack others. The
headers of all files are found by one distributed scan; the files of one header are a layout and
are read together, by title, and the layouts are put together by ledger column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.sources.ledger import (
    DATE_FORMAT, csv_options, normalise_titles, parse_ledger, text_schema,
)

_GLOB = re.compile(r"([\\\[\]{}*?])")


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, header: the first line of every file under ``path`` that has one.

    A file's first line is the first row of the split that starts at byte 0. Each task keeps one
    line per file, so no more than that is shuffled; the text itself is read once.
    """
    lines = (spark.read.option("recursiveFileLookup", True).text(path)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("at")))
    return (lines.where("at = 0").withColumn("row", F.monotonically_increasing_id())
            .groupBy("file").agg(F.min_by("value", "row").alias("header")))


def layouts(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(header, files) for every header under ``path``. The driver gets one path per file, which
    it lists in any read, and one header per layout. ``file_headers`` has paths as Spark's
    metadata gives them, in URL form; here they are as a reader takes them."""
    found = file_headers(spark, path).groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return sorted((r["header"], [unquote(f) for f in r["files"]]) for r in found.collect())


def read_ledger_folder(
    spark: SparkSession,
    path: str,
    date_format: str | Sequence[str] = DATE_FORMAT,
    optional: Sequence[str] = (),
    on_bad: str = "fail",
) -> DataFrame:
    """The ledger from all CSV files under ``path`` (subfolders too), whatever their headers.

    Ledger columns named in ``optional`` are null where a layout lacks them; any other missing
    column is an error that names it. Titles that the ledger does not know are passed over. Bad
    rows as in ``parse_ledger``. Files with a header only give no rows, empty files are passed
    over, and a folder without any header is an error. Headers must not hold line breaks.
    """
    formats = (date_format,) if isinstance(date_format, str) else tuple(date_format)
    found = layouts(spark, path)
    if not found:
        raise ValueError(f"no ledger file with a header under {path}")
    parts = []
    for _, files in found:
        names = [_GLOB.sub(r"\\\1", f) for f in files]
        columns = spark.read.options(**csv_options()).csv(names[0]).columns
        raw = normalise_titles(spark.read.options(**csv_options()).schema(text_schema(columns)).csv(names))
        lacking = {c: F.lit(None).cast("string") for c in optional if c not in raw.columns}
        parts.append(parse_ledger(raw.withColumns(lacking) if lacking else raw, formats, on_bad))
    return reduce(DataFrame.unionByName, parts)
