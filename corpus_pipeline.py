"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Every stage takes null and empty texts, repeated rows, empty tables and columns
of any names: a stage passes on all columns it is given. Null texts are not
toxic, have no copies and no benchmark items, stay null, and are not taken by
the mix, as they have no words. Rows with a null doc_id are kept by all stages
but the mix's draw, which takes them as documents of their own; of repeated rows
with one doc_id and text, one stays. The last stage adds ``size, source_size,
target, copies, taken`` in place of columns of these names.

``ORACLE_SQL`` is None: SQL cannot express the trained classifier, the latent
search and the random rounding; ``tests/llm/test_pipeline.py`` holds the near-duplicate
stage against brute force and the others against what their decisions must show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontamination, mixing, near_dedup, pseudonyms, toxicity
from evidentia.llm.shared import SMALL_BATCH_BYTES, materialize, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, calls toxic go."""
    chain = toxicity.fit(*(table(spark, sf_dir, name, SMALL_BATCH_BYTES) for name in ("documents", "labels")))
    return toxicity.reject(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest doc_id stays, once."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = near_dedup.near_duplicates(docs, k=5, percent=80, whole=1024, blocks=16)
    found = materialize(found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")), "kept")
    out = docs.join(found.where("not kept").select("doc_id").hint("merge"), "doc_id", "left_anti")
    repeated = found.where("kept and rows > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return out.select(columns)
    once = out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(repeated, "doc_id", "left_anti").unionByName(once).select(columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark", SMALL_BATCH_BYTES))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms of the same format; only the numbers of IP addresses may change their length."""
    return pseudonyms.pseudonymize(docs, pseudonyms.session_key(spark), kinds=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies; the others go."""
    keys = ["_doc", "_source", "_size"]
    result = ["source_size", "target", "copies"]
    taken = mixing.mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    taken = taken.agg(F.first("source_size").alias("_source_size"), F.first("target").alias("_target"), F.max("copies").alias("_copies"))
    kept = [c for c in docs.columns if c not in ("size", "taken", *result)]
    sized = docs.select(*(F.col(f"`{c}`") for c in kept), mixing.word_count(F.col("text")).alias("size"))
    same = [sized[c].eqNullSafe(taken[k]) for c, k in zip(("doc_id", "source", "size"), keys, strict=True)]
    joined = sized.join(taken.hint("merge"), same)
    return joined.select(*(sized[f"`{c}`"] for c in kept), sized["size"], *(F.col(f"_{c}").alias(c) for c in result), (F.col("_copies") * sized["size"]).alias("taken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", hide_private),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
