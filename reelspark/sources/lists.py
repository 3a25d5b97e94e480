"""Lists of stream sources: CSV, and the older spreadsheet form."""

from __future__ import annotations

import os
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import cell_id, first_filled, is_enabled, slug_path
from ..functions.urls import is_youtube

REQUIRED = ("id", "place", "city", "country", "url")
#: Columns of the older form and what they are called now, fixed values.
OLDER = {"id": "No.", "place": "Place Name", "city": "City", "country": "Country", "url": "Link", "description": "Short description"}


def canonical(rows: DataFrame) -> DataFrame:
    """Enabled sources that aren't YouTube: id, place, city, country, url, description, slug. Takes the names of either form."""
    have = set(rows.columns)

    def value(name: str) -> Column:
        found = [F.col(f"`{n}`").cast("string") for n in (name, OLDER.get(name)) if n in have]
        return first_filled(*found) if found else F.lit(None).cast("string")

    def named(name: str) -> Column:
        return F.trim(F.coalesce(value(name), F.lit("unknown")))

    identifier = F.coalesce(*[F.col(f"`{n}`").cast("string") for n in ("id", OLDER["id"]) if n in have])
    enabled = is_enabled(F.col("enabled")) if "enabled" in have else F.lit(True)
    url = F.trim(value("url"))
    out = rows.filter(enabled & value("url").isNotNull() & ~is_youtube(url))
    order = ["position"] if "position" in have else []
    out = out.select(*order, cell_id(identifier).alias("id"), named("place").alias("place"), named("city").alias("city"), named("country").alias("country"), url.alias("url"), F.trim(value("description")).alias("description"))
    return out.withColumn("slug", slug_path(F.col("country"), F.col("city"), F.col("place")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a CSV file with a header, UTF-8 with or without a byte-order mark."""
    rows = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿").strip('"') for c in rows.columns])
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"a source list must have the columns {', '.join(REQUIRED)}; {', '.join(missing)} missing")
    return canonical(rows)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Sources of the first sheet of a binary workbook: rows below the header that names the older columns; a later header binds anew."""
    try:
        from pyxlsb import open_workbook
    except ImportError as e:
        raise RuntimeError("pyxlsb is needed to read a binary workbook") from e
    with open_workbook(path) as book, book.get_sheet(book.sheets[0]) as sheet:
        cells = [[c.v for c in row] for row in sheet.rows()]
    return from_cells(spark, cells)


def from_cells(spark: SparkSession, cells: list[list]) -> DataFrame:
    """The same from rows of cells; a sheet of a workbook fits the driver.

    Each row goes with the header that was seen last: a running choice over the sheet, headers and what lies above the first left out.
    """
    wanted = [*OLDER.values(), "enabled"]
    titles = [{str(v).strip(): i for i, v in enumerate(row) if v is not None} for row in cells]
    headers = [t if all(OLDER[n] in t for n in REQUIRED) else None for t in titles]
    bound = accumulate(headers, lambda seen, new: new or seen)
    at = lambda row, i: row[i] if i is not None and i < len(row) else None
    text = lambda v: None if v is None else str(v)
    rows = [[text(at(row, places.get(n))) for n in wanted] for row, new, places in zip(cells, headers, bound, strict=True) if places and not new]
    return canonical(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in wanted)))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".xlsb":
        return read_workbook(spark, path)
    raise ValueError(f"unknown form of source list {suffix or '(none)'}")
