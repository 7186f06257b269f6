"""Catalog tables made from the test data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenads.operators.quality import require_table
from lumenads.plans.testbed import impressions
from lumenads.registry.core import register
from lumenads.registry.journeys import RAW
from lumenads.schemas import struct_of
from lumenads.session import shared_dir
from lumenads.sources import catalog as C
from lumenads.sources.files import write_partitioned

SHAPE = struct_of("impression_id string, user_id string, cost_per_impression double")


def _external(spark, d):
    """Impressions by year as files, then a table declared over them."""
    root = shared_dir(spark, "external")
    write_partitioned(impressions(spark, d).select(*SHAPE.names, "year"), root, ("year",))
    name = f"lumenads_{uuid.uuid4().hex}"
    C.create_external_table(spark, name, SHAPE, root, ("year",))
    C.repair_partitions(spark, name)
    return name


def _read_and_dropped(spark, name, rows):
    """Result of a query over a table that is dropped after it."""
    path = shared_dir(spark, "from-table")
    rows.write.parquet(path)
    C.drop_table(spark, name)
    return spark.read.schema(rows.schema).parquet(path)


_YEARS = f"WITH {RAW} SELECT year, COUNT(*) AS impressions, COUNT(DISTINCT user_id) AS users FROM imp GROUP BY 1"


def _by_year(rows):
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("impressions"), F.count_distinct("user_id").alias("users"))


@register("A7_create_external_table", _YEARS)
def _(spark, d):
    name = _external(spark, d)
    return _read_and_dropped(spark, name, _by_year(spark.table(name)))


@register("A8_repair_partitions", f"WITH {RAW} SELECT DISTINCT 'year=' || year AS partition FROM imp")
def _(spark, d):
    name = _external(spark, d)
    return _read_and_dropped(spark, name, C.list_partitions(spark, name))


@register("A9_catalog_checks", f"WITH {RAW} SELECT COUNT(*) > 0 AS before, COUNT(*) = 0 AS after, COUNT(DISTINCT year) AS partitions FROM imp")
def _(spark, d):
    name = _external(spark, d)
    before = C.table_exists(spark, name)
    parts = C.list_partitions(spark, name).agg(F.count(F.lit(1)).alias("partitions"))
    C.drop_table(spark, name)
    after = C.table_exists(spark, name)
    return parts.select(F.lit(before).alias("before"), F.lit(after).alias("after"), "partitions")


@register("Q4_dependency_check", _YEARS)
def _(spark, d):
    name = _external(spark, d)
    require_table(spark, name)
    return _read_and_dropped(spark, name, _by_year(spark.table(name)))
