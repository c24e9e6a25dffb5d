"""Landed API pages: positional rows with a column list per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PAGE_SCHEMA = "page int, columnNames array<string>, rowData array<array<string>>, hasMore boolean"


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON pages, one per line or one per file."""
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", multi_line).json(path)


def named_rows(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of all pages with the wanted columns looked up by name: ``{source name: output name}``.

    Pages may order their columns differently; a column a page lacks is null.
    Each row keeps its page and place as the source order.
    """
    row = pages.select("page", "columnNames", F.posexplode("rowData").alias("place", "row"))

    def cell(name):
        at = F.array_position("columnNames", F.lit(name)).cast("int")
        return F.when(at > 0, F.get("row", at - 1))

    return row.select("page", "place", *[cell(src).alias(dst) for src, dst in columns.items()])


def filter_rows(rows: DataFrame, column: str, value) -> DataFrame:
    """Rows with ``column = value``; on a Parquet table the filter reaches the scan."""
    return rows.where(F.col(column) == F.lit(value))
