import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import bpe
from evidentia.llm.entry import op12_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "  ", "\n", "'s", "'ll", "é", "ß", "1", "½", "中", "　", "\x1c", "\x85", "\x00", "<|endoftext|>", "<|endof", "!", "…", "e", "th", "in", "\t", "🙂", "́"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(vocabulary, text):
    return array("i", vocabulary.encode(text)).tolist()


def test_texts_match_the_library(library):
    vocabulary = bpe.vocabulary(open(PATH).read())
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += [f"a{chr(c)}1 {chr(c)} {chr(c) * 2}!" for c in [*range(0xD800), *range(0xE000, 0x30000)]]
    texts += ["ab" * 30_000, " " * 5000 + "x", "<|endoftext|>" * 3, "q" * 5000]
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ids_of(vocabulary, text)
        assert ids == known.ids
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_in_the_library(library):
    vocabulary = bpe.vocabulary(open(PATH).read())
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(40)]
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert vocabulary.decode([None, 10**6, -5]) == ""


def test_pieces_and_a_full_table_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "CACHED", 3)
    vocabulary = bpe.Vocabulary(open(PATH).read())
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(ODD) for _ in range(60))
        assert ids_of(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_columns_nulls_and_empty_tables(spark, library):
    long = "Some words that go on and on. " * 60_000
    rows = [(1, "Hello  world's 12", "x"), (1, "Hello  world's 12", "x"), (2, None, "y"), (3, "", None), (None, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").selectExpr("*", "'clash' as ids")
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "a.b", "ids"]
    got = [(r.doc_id, r["a.b"], r.ids) for r in encoded.collect()]
    assert got == [(i, b, library.encode(t or "", add_special_tokens=False).ids) for i, t, b in rows]
    decoded = bpe.decode(encoded.selectExpr("doc_id", "ids", "1 as text"), PATH)
    assert [(r.doc_id, r.text) for r in decoded.collect()] == [(i, t or "") for i, t, _ in rows]
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(none, PATH).collect()] == ["", ""]
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_other_kinds_of_files_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        bpe.encode(spark.createDataFrame([], "text string"), public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op12_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
