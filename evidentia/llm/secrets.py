"""Secrets in texts: three known shapes, and tokens that pass a battery of randomness tests.

All work is done by SQL functions. Tokens of ``LEAST`` or more encoding
characters with a letter and a digit are candidates unless they overlap a known
shape. Each is read in the smallest encoding that holds it (hex, base 32,
letters and digits, base 64), and three tests ask if its values look random:
chi-squared uniformity over the alphabet, runs above and below the middle, and
serial correlation. The p-value is three times the least of the three.

Randomness is the null hypothesis. Short tokens give the tests little power and
long ones much, so rejections are controlled within bands of length: in each
band Benjamini and Hochberg's rule, at ``FDR`` over all candidates of all
texts, finds the tokens that are not random, and the rest is reported. The rule
runs on counts of p-values in ``BINS`` steps, so what reaches the driver is one
threshold per band, whatever the input.

Defined results: a null text is empty; empty texts have no spans; offsets count
code points of the whole text, end exclusive; repeated rows each get their row;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

#: The known shapes and the length that the whole match, or the given group, needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KNOWN = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
#: The same spans with fewer matches: a run is as long as it gets, so a short one holds no long one.
_FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
LEAST, FDR, BINS = 20, 0.05, 1000
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % LEAST
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Tokens up to these lengths are judged together.
BANDS = (32, 48, 80, 160)
_FOUND = "array<struct<start: int, stop: int, found: string>>"


def located(text: Column, pattern: str) -> Column:
    """Start, stop and text of the leftmost matches that don't overlap."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("found"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.aggregate(rows, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_FOUND))


def _known(text: Column, rank: int) -> Column:
    kind, pattern, group, least = KNOWN[rank]
    spans = located(text, _FAST.get(kind, pattern))
    if group:
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["found"], pattern, group)) >= least)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def known_spans(text: Column) -> Column:
    """Spans of the three shapes: start, rank, kind, stop, in order."""
    return F.array_sort(F.concat(*(_known(text, rank) for rank in range(len(KNOWN)))))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (Abramowitz and Stegun 7.1.26)."""
    x = z / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)


def randomness(token: Column) -> Column:
    """p-value of the battery under the hypothesis that the token is random."""
    alphabet = F.lit(None).cast("string")
    for shape, letters in reversed(ENCODINGS):
        alphabet = F.when(token.rlike(shape), F.lit(letters)).otherwise(alphabet)
    k, n = F.length(alphabet).cast("double"), F.length(token).cast("double")

    def count(letter: Column) -> Column:
        return (n - F.length(F.replace(token, letter, F.lit("")))).cast("double")

    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: acc + count(c) * count(c))
    uniform = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    p_uniform = F.when(uniform > 0, _tail(uniform)).otherwise(0.5)

    values = F.transform(F.split(token, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    pairs = F.arrays_zip(F.slice(values, F.lit(1), F.size(values) - 1).alias("a"), F.slice(values, F.lit(2), F.size(values) - 1).alias("b"))
    half = k / 2
    high = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.when(v >= half, 1.0).otherwise(0.0))
    runs = F.aggregate(pairs, F.lit(1.0), lambda acc, x: acc + F.when((x["a"] >= half) != (x["b"] >= half), 1.0).otherwise(0.0))
    both = 2 * high * (n - high)
    spread = both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(spread > 0, 2 * _tail(F.abs(runs - both / n - 1) / F.sqrt(spread))).otherwise(0.0)

    mean = (k - 1) / 2
    product = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + (x["a"] - mean) * (x["b"] - mean))
    p_serial = 2 * _tail(F.abs(product) / ((k * k - 1) / 12 * F.sqrt(n - 1)))
    return F.least(F.lit(1.0), 3 * F.least(p_uniform, p_runs, p_serial))


def _band(length: Column) -> Column:
    out = F.lit(len(BANDS))
    for i, most in reversed(list(enumerate(BANDS))):
        out = F.when(length <= most, i).otherwise(out)
    return out


def thresholds(candidates: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """Of each band, the p-value up to which tokens are not random, from (band, p)."""
    step = F.ceil(F.col("p") * BINS).cast("int")
    counts = candidates.groupBy("band", step.alias("step")).count()
    upto = F.sum("count").over(W.partitionBy("band").orderBy("step"))
    total = F.sum("count").over(W.partitionBy("band"))
    kept = counts.withColumn("fits", F.col("step") / BINS <= fdr * upto / total).where("fits")
    return {r.band: r.step / BINS for r in kept.groupBy("band").agg(F.max("step").alias("step")).collect()}


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, known and random (arrays of spans) for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.filter(located(text, CANDIDATE), lambda c: c["found"].rlike("[0-9]") & c["found"].rlike("[A-Za-z]"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), known_spans(text).alias("known"), tokens.alias("tokens"))
    free = F.filter("tokens", lambda c: ~F.exists("known", lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"])))
    rows = materialize(rows.withColumn("tokens", free), "tokens")

    def judged(c: Column) -> Column:
        p = F.coalesce(randomness(c["found"]), F.lit(0.0))
        return F.struct(c["start"].alias("start"), F.lit(len(KNOWN)).alias("rank"), F.lit("random").alias("kind"), c["stop"].alias("stop"), p.alias("p"), _band(F.length(c["found"])).alias("band"))

    rows = materialize(rows.select("doc_id", "known", F.transform("tokens", judged).alias("judged")), "judged")
    limits = thresholds(rows.select(F.explode("judged").alias("j")).select("j.band", "j.p"), fdr)
    limit = F.create_map(*(F.lit(x) for band in range(len(BANDS) + 1) for x in (band, float(limits.get(band, 0.0)))))
    random = F.filter("judged", lambda j: j["p"] > F.element_at(limit, j["band"]))
    return rows.select("doc_id", "known", F.transform(random, lambda j: F.struct(j["start"].alias("start"), j["rank"].alias("rank"), j["kind"].alias("kind"), j["stop"].alias("stop"))).alias("random"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digests(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("known", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind, *_ in KNOWN),
        F.sha2(_joined(F.col("known")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("known", "random"))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
