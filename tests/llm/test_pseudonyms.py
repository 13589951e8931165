import datetime
import hashlib
import re

from evidentia.llm.pseudonyms import ROUNDS, pseudonymize, session_key

KEY = "a key for tests"

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, m string, kind string"


def feistel(a, b, many_a, many_b, kind):
    for i in range(ROUNDS):
        value = b if i % 2 == 0 else a
        h = int(hashlib.sha256(f"{KEY}|{kind}|{i}|{value}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            a = (a + h) % many_a
        else:
            b = (b + h) % many_b
    return a, b


def digits(s, kind):
    h = len(s) // 2
    a, b = feistel(int(s[:h] or 0), int(s[h:]), 10**h, 10 ** (len(s) - h), kind)
    return (f"{a:0{h}d}" if h else "") + f"{b:0{len(s) - h}d}"


def luhn(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def number(s):
    plain = re.sub("[^0-9]", "", s)
    new = digits(plain[:-1], "number")
    new += str((luhn(new) + int(plain[-1]) - luhn(plain[:-1])) % 10)
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in s)


def run(spark, texts):
    out = pseudonymize(spark.createDataFrame([(i, t, "m", "k") for i, t in enumerate(texts)], DOCS), KEY).collect()
    assert [set(r.asDict()) for r in out[:1]] in ([], [{"doc_id", "text", "m", "kind", "pii_kinds"}])
    return {r.doc_id: r for r in out}


def test_numbers_ips_and_dates_match_brute_force(spark):
    texts = ["a 4111 1111-1111 1111.", "no 9807915762804490%%%", "ip 97.51.17.173.", "born 2024-02-29!", "am 31.12.1999 und", "le 05/06/2011,", "x 123-45-6789 y"]
    got = run(spark, texts)
    assert got[0].text == f"a {number('4111 1111-1111 1111')}."
    assert luhn(re.sub("[^0-9]", "", got[0].text)[:-1]) == int(got[0].text[-2])
    assert got[1].text == f"no {number('9807915762804490')}%%%"
    a, b = feistel(97 * 256 + 51, 17 * 256 + 173, 65536, 65536, "ip")
    assert got[2].text == f"ip {a >> 8}.{a & 255}.{b >> 8}.{b & 255}."
    first = datetime.date(1800, 1, 1)
    for i, day, form in ((3, datetime.date(2024, 2, 29), "%Y-%m-%d"), (4, datetime.date(1999, 12, 31), "%d.%m.%Y"), (5, datetime.date(2011, 6, 5), "%d/%m/%Y")):
        n = (day - first).days
        a, b = feistel(n // 773, n % 773, 189, 773, "date")
        assert (first + datetime.timedelta(a * 773 + b)).strftime(form) in got[i].text
    new = digits("123456789", "ssn")
    assert got[6].text == f"x {new[:3]}-{new[3:5]}-{new[5:]} y"
    assert [r.pii_kinds for r in got.values()] == [["number"], ["number"], ["ip"], ["iso_date"], ["day_date"], ["day_date"], ["ssn"]]


def test_planted_values_go_and_stay_linked(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in pseudonymize(docs, KEY).collect()}
    shapes = [r"[A-Za-z0-9.]+@[\w-]+(?:\.[\w-]+)+", r"(?<![0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9])", r"\+1 \(\d{3}\) 555-\d{4}", r"(?<![0-9A-Za-z])\d{16}(?![0-9A-Za-z])"]
    names, seen = {}, 0
    for i, text in before.items():
        for shape in shapes:
            old, new = re.findall(shape, text), re.findall(shape.replace("555", r"\d{3}"), after[i])
            assert len(old) == len(new)
            for x, y in zip(old, new, strict=True):
                seen += 1
                assert x != y and names.setdefault(x, y) == y
        if not re.search(r"[0-9@]", text):
            assert after[i] == text
    assert seen > 500 and len(set(names.values())) == len(names)


def test_what_fails_validation_stays(spark):
    texts = ["300.1.1.1", "2023-02-31", "31/13/2020", "", None, "deadbeef0123456789012345", "v 1.2.3.4.5", "12345", "é" * 50_000, "a@b", "x" * 300_000]
    assert [r.text for _, r in sorted(run(spark, texts).items())] == texts
    assert pseudonymize(spark.createDataFrame([], DOCS), KEY).count() == 0


def test_emails_keep_form_and_are_permuted(spark):
    texts = [f"{a}{b}.x-{n}@mail.example.org" for a in "abz" for b in "AZ" for n in range(10)] + ["q@e.io", "ÿq@e.io"]
    got = [r.text for _, r in sorted(run(spark, texts).items())]
    assert len(set(got)) == len(texts) - 0
    assert all(re.fullmatch(r"[a-z][A-Z]\.[a-z]-[0-9]@mail\.example\.org", t) for t in got[:-2])


def test_the_key_is_secret_and_columns_stay(spark):
    docs = spark.createDataFrame([(1, "call 555-123-4567", ["mine"])], "doc_id long, text string, pii_kinds array<string>")
    mine, other = (pseudonymize(docs, k, kinds=None).first() for k in (session_key(spark), "another"))
    assert mine.pii_kinds == ["mine"]
    assert len({mine.text, other.text, "call 555-123-4567"}) == 3
    assert session_key(spark) == session_key(spark) and len(session_key(spark)) == 64
