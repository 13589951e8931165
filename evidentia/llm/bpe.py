"""Byte-level BPE: texts to token ids and back, with a public vocabulary file.

A text is cut at the file's special tokens, then into words by the byte-level
pattern; each word's bytes are symbols of a doubly linked list. A priority
queue holds the merges of neighbours by rank, then place. The first is taken
again and again, unless it is stale (a symbol of it is gone, or its right
neighbour gives another merge by now); a merge links its symbol to the next and
queues its two new pairs. So a word of n bytes takes n log n steps, at any
length. Decoding concatenates the bytes of the vocabulary's strings.

The driver reads the file (its path is a parameter) and sends its text, under
2 MB, to the tasks, so executors need no copy. Each row is handled where it
lies; nothing is shuffled. Words that occur again come from a table that is
emptied at ``CACHED`` words and holds none over ``CACHED_CHARS`` characters.

Defined results: a null or empty text has no tokens and decodes to the empty
text; null ids decode to the empty text; ids that the vocabulary lacks and null
ids within a list stand for nothing; bytes that aren't UTF-8 become U+FFFD, as
in the library; repeated rows get a row each; an empty table gives no rows;
extra columns are passed on unless they have the name of the result. Long texts
are cut in front of white space after ``PIECE`` characters, where no word
reaches over, so only words without any white space are held whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import BATCH_BYTES, mapped

#: Words of the table of known words, and the longest it holds.
CACHED, CACHED_CHARS = 1 << 19, 64
#: Characters after which a long text is cut at the next white space.
PIECE = 1 << 20
#: The pattern of the byte-level pre-tokenizer; a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(r"\S\s")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Vocabulary:
    """Tables of a tokenizer file of the kind described above; others are refused."""

    def __init__(self, file: str):
        said = json.loads(file)
        model = said["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        before = said.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and (said.get("decoder") or {}).get("type") == "ByteLevel"
        marks = said.get("added_tokens") or []
        if odd or model.get("type") != "BPE" or not plain or said.get("normalizer") or said.get("post_processor") or any(t.get(k) for t in marks for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"not a plain byte-level BPE file: {odd or before}")
        ids = model["vocab"]
        letters = byte_letters()
        self.first = [ids[c] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: By left symbol the ranks of its merges with a right one, and the symbol that the merge of a rank makes.
        none: dict[int, int] = {}
        self.after, self.result = [none] * (max(ids.values()) + 1), []
        for rank, (a, b) in enumerate(pairs):
            if self.after[ids[a]] is none:
                self.after[ids[a]] = {}
            self.after[ids[a]][ids[b]] = rank
            self.result.append(ids[a + b])
        value = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in marks}
        self.bytes = {i: bytes(value[c] for c in token) for token, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        # The longest first, so that of tokens that begin at one place it is found.
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(WORDS)
        self.known = _Known(self)

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, by rank, then place."""
        n, after, result = len(symbols), self.after, self.result
        # An entry is a rank and a place in one integer; for usual words it is a small one.
        shift = n.bit_length()
        places = (1 << shift) - 1
        queue = [rank << shift | i for i, (a, b) in enumerate(pairwise(symbols)) if (rank := after[a].get(b)) is not None]
        if not queue:
            return symbols
        heapify(queue)
        right, left = [*range(1, n), -1], list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i, rank = entry & places, entry >> shift
            j, symbol = right[i], symbols[i]
            if symbol < 0 or j < 0:
                continue  # stale: a symbol is gone
            new, now = result[rank], after[symbol].get(symbols[j])
            if now != rank and (now is None or result[now] != new):
                continue  # stale: another neighbour
            symbols[i], symbols[j] = new, -1
            k, h = right[j], left[i]
            right[i] = k
            if k >= 0:
                left[k] = i
                if (now := after[new].get(symbols[k])) is not None:
                    heappush(queue, now << shift | i)
            if h >= 0 and (now := after[symbols[h]].get(new)) is not None:
                heappush(queue, now << shift | h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        ids = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                ids.append(array("i", [self.special[part]]).tobytes())
                continue
            begin = 0
            while begin < len(part):
                m = _CUT.search(part, begin + PIECE)
                end = m.start() + 1 if m else len(part)
                ids.append(b"".join(map(self.known.__getitem__, self.pattern.findall(part, begin, end))))
                begin = end
        return b"".join(ids)

    def decode(self, ids: list[int | None]) -> str:
        try:
            raw = b"".join(map(self.bytes.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.bytes.get(i, b"") for i in ids)
        return raw.decode("utf-8", "replace")


class _Known(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        first = self.vocabulary.first
        ids = array("i", self.vocabulary.merged([first[b] for b in word.encode()])).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


def _schema(rows: DataFrame, without: tuple[str, ...], more: StructField) -> tuple[list[str], StructType]:
    kept = [f for f in rows.schema.fields if f.name not in without]
    return [f.name for f in kept], StructType([*(StructField(f.name, f.dataType) for f in kept), more])


def encode(docs: DataFrame, path: str, column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` without ``column``, with its token ids in ``into``."""
    kept, schema = _schema(docs, (column, into), StructField(into, ArrayType(IntegerType())))
    file = Path(path).read_text()
    vocabulary(file)  # refuses unknown kinds before any task runs
    held = docs.sparkSession.sparkContext.broadcast(file)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(held.value)
        for batch in batches:
            texts, begin, ids, size = batch.column(len(kept)), 0, [], 0
            for at, text in enumerate(texts):
                ids.append(voc.encode(text.as_py() or ""))
                size += len(ids[-1])
                if size >= BATCH_BYTES or at + 1 == len(texts):
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i)[begin : at + 1] for i in range(len(kept))), own], names=schema.names)
                    begin, ids, size = at + 1, [], 0

    return mapped(docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`")), apply, schema)


def decode(rows: DataFrame, path: str, column: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of the token ids in ``column``."""
    kept, schema = _schema(rows, (into,), StructField(into, StringType()))
    at = kept.index(column)
    held = rows.sparkSession.sparkContext.broadcast(Path(path).read_text())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(held.value)
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                own = ids.values if ids.is_valid else pa.array([], pa.int32())
                texts.append(voc.decode(own.to_pylist() if own.null_count else own.to_numpy().tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return mapped(rows.select(*(F.col(f"`{c}`") for c in kept)), apply, schema)
