"""Queries of what keeps state: keyed tables, the stream of candidates, names taken in order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators.keyed_table import KeyedTable
from .plans.localities import localities
from .queries import FUSION_SQL, TODAY, _t, candidates, query
from .session import shared_dir
from .streaming import ingest


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""with n as (select o_custkey as k, max(o_orderdate) as last, count(*) as v from orders where o_orderstatus = 'F' group by o_custkey)
    select c_custkey as k, coalesce(v, 0)::bigint as v, strftime(last, '%Y-%m-%d') as last from customer left join n on k = c_custkey where c_mktsegment <> 'MACHINERY'""")
def keyed_table(spark, sf_dir):
    """Customers in a keyed table; those with finished orders are written over, a segment is removed, buckets are folded."""
    table = KeyedTable(spark, _folder(spark, "keyed"), ["k"], buckets=16)
    c = _t(spark, sf_dir, "customer")
    table.write(c.select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("v")))
    o = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k"))
    table.write(o.agg(F.count("*").alias("v"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last")))
    table.compact(2)
    table.remove(c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("k")))
    return table.current()


@query(FUSION_SQL)
def stream_verdicts(spark, sf_dir):
    """Verdicts that a stream keeps current: all candidates come as files, in two runs of the stream with one checkpoint."""
    home = _folder(spark, "stream")
    rows = candidates(spark, sf_dir).withColumn("gkey", F.col("gkey").cast("string"))
    rows = rows.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in ingest.CANDIDATES.split(", ")))
    for half in (0, 1):
        rows.where(F.col("seq") % 2 == half).write.mode("append").parquet(f"{home}/in")
        ingest.follow_candidates(spark, f"{home}/in", f"{home}/state", f"{home}/checkpoint", TODAY, buckets=16).awaitTermination()
    v = ingest.verdict_table(spark, f"{home}/state", 16).current()
    return v.select(F.col("gkey").cast("long").alias("gkey"), "iso", "display", "status", "label", "confidence", "sources", "best_url", "alternatives", "rera_date")


@query()
def locality_names(spark, sf_dir):
    """The first two words of each text as a place: those of English texts are known ones, the others stand in a register; like names are taken once, in order."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "lang", F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1).alias("locality"))
    return localities(d.where("lang = 'en'"), d.where("lang <> 'en' or lang is null"))
