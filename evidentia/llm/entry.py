"""The queries of this subpackage, for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontamination, filter_audit, html_text, media_chunks, mixing, near_dedup, pseudonyms, secrets, toxicity, vector_codes, warc
from .shared import scratch_path, table


def op8_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.round_trip(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, whole=1024, blocks=16)


def op1_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).withColumn("is_toxic", F.col("toxic") >= toxicity.THRESHOLD)


def op2_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op3_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives, then read responses with their payloads and revisits by their headers."""
    warc.register(spark)
    path = warc.qualified(spark, scratch_path(spark, "warc"))
    warc.deduplicated(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc")
    full = read.load(path).where("record_type = 'response'").select(
        warc.page_of("record_id").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        warc.payload_digest("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = read.option("payload", "false").load(path).where("record_type = 'revisit'").select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to")
    )
    return full.unionByName(revisits)


def op6_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonyms.session_key(spark))
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_private"), F.array_join("pii_kinds", ",").alias("kinds"))


#: A conversation whose texts hold control strings, as the contract has it.
PROBE = r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    parts = chat_format.segments(turns.unionByName(probe))
    return chat_format.digests(chat_format.read_back(chat_format.formatted(parts)))


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chain": op1_chain,
    "op2_randomness": op2_randomness,
    "op3_pivotal": op3_pivotal,
    "op4_blocks": op4_blocks,
    "op5_warc": op5_warc,
    "op6_feistel": op6_feistel,
    "op7_chat": op7_chat,
    "op8_latent": op8_latent,
    "op9_media": op9_media,
    "op10_minhash": op10_minhash,
    "op11_codebooks": op11_codebooks,
    "op12_bpe": op12_bpe,
    "op13_audit": op13_audit,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op11_codebooks": """
        with kept as (
            select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), parts as (
            select vec_id, label, p, v[4 * p + 1 : 4 * p + 4] as x from kept, range(16) r(p)
        ), c0 as (
            select p, (dense_rank() over (order by vec_id) - 1)::int as e, x as c from parts qualify e < 64
        ), a1 as (
            select vec_id, label, p, x, b.d as d, b.e as e from (select vec_id, label, p, x, min({'d': d, 'e': e}) as b from (
                select vec_id, label, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
                from parts join c0 using (p)
            ) group by all)
        ), c1 as (
            select p, e, coalesce(m, c) as c from c0 left join (
                select p, e, list(v order by k) as m from (
                    select p, e, k, floor(sum(x[k]) / count(*))::bigint as v from a1, range(1, 5) r(k) group by all
                ) group by all
            ) using (p, e)
        ), a2 as (
            select vec_id, label, p, x, b.d as d, b.e as e from (select vec_id, label, p, x, min({'d': d, 'e': e}) as b from (
                select vec_id, label, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
                from parts join c1 using (p)
            ) group by all)
        ), c2 as (
            select p, e, coalesce(m, c) as c from c1 left join (
                select p, e, list(v order by k) as m from (
                    select p, e, k, floor(sum(x[k]) / count(*))::bigint as v from a2, range(1, 5) r(k) group by all
                ) group by all
            ) using (p, e)
        ), a3 as (
            select vec_id, label, p, x, b.d as d, b.e as e from (select vec_id, label, p, x, min({'d': d, 'e': e}) as b from (
                select vec_id, label, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
                from parts join c2 using (p)
            ) group by all)
        ), coded as (
            select vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a3 group by all
        ), books as (
            select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from c2
        )
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, books""",
    "op13_audit": r"""
        with docs as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
        ), words as (
            select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from docs
        ), failing as (
            select part, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic,
                (case when len(w) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end)
                + (case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) then 4 else 0 end)
                + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
                + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) as mask
            from words left join labels l using (doc_id)
        ), counts as (
            select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failing group by all
        ), letters as (
            select unnest(['A', 'B', 'C', 'D', 'E']) as c
        ), orders as (
            select a.c || b.c || c.c || d.c || e.c as filter_order from letters a, letters b, letters c, letters d, letters e
            where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
        ), steps as (
            select filter_order, step::int as step, (1 << (ascii(filter_order[step]) - 65))::int as bit,
                list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::int as before
            from orders, range(1, 6) r(step)
        ), done as (
            select filter_order, step, bit, coalesce(before, 0) as before from steps
        )
        select part, filter_order, step,
            coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept,
            coalesce(sum(n) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as removed,
            coalesce(sum(n) filter (mask & bit > 0 and mask & before > 0), 0)::bigint as redundant,
            coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
            coalesce(sum(good) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as good_lost,
            coalesce(sum(toxic) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as toxic_lost,
            coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) filter (mask & bit > 0), 0)::bigint as shapley
        from counts, done group by part, filter_order, step""",
    "op7_chat": r"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), turns as (
            select conv_id,
                list({'role': role, 'text': text} order by turn nulls last, role collate "C", text collate "C") as t
            from rows group by conv_id
        ), parts as (
            select conv_id, t,
                array_to_string(list_transform(t, lambda x: x.role || chr(10) || x.text || chr(10)), '') as whole,
                coalesce(array_to_string(list_transform(list_filter(t, lambda x: x.role = 'assistant'), lambda x: x.text), ''), '') as kept,
                array_to_string(list_transform(t, lambda x: '<turn ' || replace(replace(replace(x.role, '\', '\b'), '<', '\l'), '>', '\g') || '>'
                    || replace(replace(replace(x.text, '\', '\b'), '<', '\l'), '>', '\g') || '</turn>'), '') as formatted,
                array_to_string(list_transform(t, lambda x: x.role), ' ') as roles
            from turns
        )
        select conv_id, len(t)::bigint as n_turns, sha256(whole) as turns_sha256, length(kept)::bigint as loss_chars,
            sha256(kept) as loss_sha256, length(formatted)::bigint as formatted_chars,
            regexp_full_match(roles, '(system )?user assistant( user assistant)*') as valid
        from parts""",
}
