"""Private values replaced by format-preserving pseudonyms, keyed and the same everywhere.

A Feistel network permutes each value within its format: the two halves take
turns, each moved on by a keyed hash of the other. So equal values keep one
pseudonym in all documents, different values keep different ones, and a holder
of the key can undo it. All work is done by SQL functions.

* card and account numbers (13 to 19 digits): digits before the last are
  permuted; the last keeps its distance from the Luhn digit, so valid numbers
  stay valid and others don't become so;
* phone and social-security numbers: all digits but the country code;
* IPv4 addresses with valid octets: the 32 bits;
* valid dates of 1800 to 2199 (year-month-day, or day and month before the
  year with ``/`` or ``.``): the day within these 400 years;
* e-mail addresses: letters and digits of the local part, each within its kind.

Separators stay. What fails validation (an octet of 300, 31 February) stays as
it is. Defined results: a null text stays null, an empty one empty; rows and
columns other than ``text`` are passed on; an empty table gives no rows; a very
long text is scanned whole.

The key is the caller's secret: whoever knows it can undo the pseudonyms.
"""

from __future__ import annotations

from functools import cache
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Session setting with the secret key; equal keys give equal pseudonyms in all runs.
KEY_SETTING = "spark.evidentia.pseudonyms.key"
_NO, _OCTET = "(?![0-9A-Za-z])", "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds in the order in which they are tried.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("ip", rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"),
    ("iso_date", rf"(?<![0-9A-Za-z-])(?:1[89]|2[01])[0-9]{{2}}-[01][0-9]-[0-3][0-9](?!-){_NO}"),
    ("day_date", rf"(?<![0-9A-Za-z/.])[0-3][0-9]([/.])[01][0-9]\1(?:1[89]|2[01])[0-9]{{2}}{_NO}"),
    ("ssn", rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-){_NO}"),
    ("phone", rf"(?<![0-9A-Za-z])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_NO}"),
    ("intl", rf"(?<![0-9A-Za-z])\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}{_NO}"),
    ("number", rf"(?<![0-9A-Za-z.+])[0-9]{{4}}(?:[ -]?[0-9]{{4}}){{2}}[ -]?[0-9]{{1,7}}{_NO}"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: 400 years have 146097 = 189 * 773 days, wherever they begin.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _hash(key: str, kind: str, turn: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, many_a: Column, many_b: Column, key: str, kind: str) -> Column:
    """The permuted pair of numbers below ``many_a`` and ``many_b``."""
    zero = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + _hash(key, kind, i, s["b"]) % many_a, many_a)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _hash(key, kind, i, s["a"]) % many_b, many_b)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, turn)


def _digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of up to 36 digits, permuted among those of its length."""
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, size)
    out = feistel(
        F.coalesce(left.try_cast("long"), F.lit(0)), right.cast("long"),
        F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), size - half).cast("long"), key, kind,
    )
    return F.concat(F.lpad(out["a"].cast("string"), half, "0"), F.lpad(out["b"].cast("string"), size - half, "0"))


def _refill(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        own = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(own, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + own.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(shape, ""), zero, step, lambda s: s["out"])


def luhn_digit(body: Column) -> Column:
    """The digit that completes ``body`` to a valid number."""
    values = F.transform(F.split(F.reverse(body), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v))
    return F.pmod(-total, F.lit(10))


def _number(match: Column, key: str) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    body, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, -1, 1).cast("int")
    new = _digits(body, key, "number")
    check = F.pmod(luhn_digit(new) + last - luhn_digit(body), F.lit(10))
    return _refill(match, F.concat(new, check.cast("string")))


def _phone(match: Column, key: str) -> Column:
    code = F.regexp_extract(match, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(match, F.length(code) + 1, F.length(match))
    return F.concat(code, _refill(rest, _digits(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))


def _ip(match: Column, key: str) -> Column:
    o = F.transform(F.split(match, r"\."), lambda x: x.cast("int"))
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    parts = [F.floor(out[h] / 256) if high else out[h] % 256 for h in "ab" for high in (True, False)]
    return F.concat_ws(".", *(p.cast("int").cast("string") for p in parts))


def _date(match: Column, form: str, key: str) -> Column:
    day = F.datediff(F.try_to_timestamp(match, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
    out = feistel(F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (out["a"] * DAYS[1] + out["b"]).cast("int"))
    return F.when(day.isNull(), match).otherwise(F.date_format(moved, form))


def _shifted(c: Column, by: Column) -> Column:
    out = c
    for first, last, many in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)):
        moved = F.chr((F.pmod(F.ascii(c) - ord(first) + by, F.lit(many)) + ord(first)).cast("int"))
        out = F.when(c.between(first, last), moved).otherwise(out)
    return out


def _email(match: Column, key: str) -> Column:
    local = F.substring_index(match, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")
    zero = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))

    def moved(part: Column, other: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other), 512)
        by = lambda at: F.conv(F.substring(digest, at * 3 % 120 + 1, F.lit(3)), 16, 10).cast("int")
        return F.array_join(F.transform(F.split(part, ""), lambda c, at: _shifted(c, by(at))), "")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even & (s["a"] != ""), moved(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], i)).alias("b"),
        )

    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, turn, lambda s: F.concat(s["a"], s["b"]))
    return F.concat(new, F.substring(match, F.length(local) + 1, F.length(match)))


def kind_of(match: Column) -> Column:
    # The look-behinds hold at the start of a match; only its own shape has to be told.
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(match, key))
        .when(kind == "ip", _ip(match, key))
        .when(kind == "iso_date", _date(match, "yyyy-MM-dd", key))
        .when((kind == "day_date") & match.contains("/"), _date(match, "dd/MM/yyyy", key))
        .when(kind == "day_date", _date(match, "dd.MM.yyyy", key))
        .when(kind == "ssn", _refill(match, _digits(F.regexp_replace(match, "[^0-9]", ""), key, "ssn")))
        .when(kind.isin("phone", "intl"), _phone(match, key))
        .when(kind == "number", _number(match, key))
        .otherwise(match)
    )


@cache
def _drawn_key() -> str:
    return token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key of ``KEY_SETTING``, or one drawn for this driver process, which nobody can know later."""
    return spark.conf.get(KEY_SETTING, None) or _drawn_key()


def pseudonymize(docs: DataFrame, key: str, text: str = "text", kinds: str | None = "pii_kinds") -> DataFrame:
    """``docs`` with private values in ``text`` replaced, and in a column ``kinds``, unless it is None, the kinds found in order."""
    source = F.col(text)
    found = F.when(source.rlike("[0-9@]") & source.rlike(ANY), F.regexp_extract_all(source, F.lit(ANY), 0))
    made = F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m")))
    changed = F.zip_with(F.split(source, ANY, -1), made, lambda gap, m: F.concat(gap, F.coalesce(pseudonym(m["m"], m["kind"], key), F.lit(""))))
    columns = {text: F.when(found.isNull(), source).otherwise(F.array_join(changed, ""))}
    if kinds:
        columns[kinds] = F.coalesce(F.transform(made, lambda m: m["kind"]), F.array().cast("array<string>"))
    return docs.withColumns(columns)
