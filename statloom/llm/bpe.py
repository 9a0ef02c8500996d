"""Byte-level BPE encoding, decoding and counting (operators 1 and 6).

A text is cut at the strings of special tokens, then into pre-tokens; a pre-token's symbols form a doubly
linked list, and a heap of merge ranks drives the merging: the lowest rank is popped, entries whose symbols
have changed since they were pushed are stale and skipped, ties go to the leftmost pair. Counting takes initial
symbols minus merges and makes no identifiers; decoding concatenates vocabulary strings.

Whole Arrow columns are cut, each batch's distinct pre-tokens go through the heap (or a bounded memo), and Arrow puts
the rows together. Both operators are map-only: no shuffle, memory per worker is one Arrow batch plus the memo.
Null text counts as empty. Texts of any length are taken whole: a pre-token of n symbols costs O(n log n).
Repeated rows give repeated results; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .util import Recent, plain, small_batches, worker_model

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies, white space by its Unicode property.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same white space for Arrow's pattern matching.
WHITE = r"[\t-\r \x{85}\p{Z}]"


def read_vocabulary(path: str) -> bytes:
    """The tokenizer file's bytes; a few MB whatever the corpus, so they may travel with every task."""
    with open(path, "rb") as f:
        return f.read()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class BytePairModel:
    """A byte-level vocabulary with its merge ranks."""

    def __init__(self, data: bytes, memo: int = 500_000):
        spec = json.loads(data)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {ord(s): b for b, s in enumerate(symbols)}
        self.first = np.array([vocab[s] for s in symbols])
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.of_bytes = np.array([[self.ranks.get(a << 20 | b, -1) for b in self.first.tolist()] for a in self.first.tolist()])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(byte_of[ord(c)] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.strings = pa.array([strings.get(i, b"") for i in range(max(strings) + 1)], pa.binary())
        self.names = pa.array([b",%d" % i for i in range(len(self.strings))], pa.binary())
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = "|".join([rf"{WHITE}[ \n](?:{WHITE}|\z)", r"\x00", *map(re.escape, self.special)])
        self.pre_tokens = regex.compile(PRE_TOKEN)
        self.words, self.sizes = Recent(memo), Recent(memo)

    def merge(self, ids: list[int], live: list[int]) -> int:
        """Merges `ids` in place, -1 for a symbol that went, and returns the number of merges.

        A heap entry is rank * n + place; `live` holds each place's present entry (-1: none), any other is stale."""
        heap = [e for e in live if e >= 0]
        if not heap:
            return 0
        n, rank_of, merged = len(ids), self.ranks.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        pop, push, done = heapq.heappop, heapq.heappush, 0
        while heap:
            e = pop(heap)
            i = e % n
            if live[i] != e:
                continue
            j = after[i]
            k = after[i] = after[j]
            new = ids[i] = merged[e // n]
            ids[j] = live[i] = live[j] = -1
            done += 1
            if k < n:
                before[k] = i
                if (r := rank_of(new << 20 | ids[k])) is not None:
                    live[i] = r = r * n + i
                    push(heap, r)
            if (h := before[i]) >= 0:
                if (r := rank_of(ids[h] << 20 | new)) is None:
                    live[h] = -1
                else:
                    live[h] = r = r * n + h
                    push(heap, r)
        return done

    def _symbols(self, words: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The arguments of `merge` for each word."""
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        size = np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words))
        end = np.cumsum(size)
        ids, live = self.first[raw].tolist(), np.full(len(raw), -1)
        live[:-1] = self.of_bytes[raw[:-1], raw[1:]]
        live[end - 1] = -1
        n = np.repeat(size, size)
        live = np.where(live >= 0, live * n + np.arange(len(raw)) - np.repeat(end - size, size), -1).tolist()
        for w, i, j in zip(words, (end - size).tolist(), end.tolist()):
            yield ([self.special[w]], []) if w in self.special else (ids[i:j], live[i:j])

    def _packed(self, words: list[str]) -> Iterator[bytes]:
        """Each word's ids as 32-bit numbers."""
        for ids, live in self._symbols(words):
            yield array("i", [i for i in ids if i >= 0] if self.merge(ids, live) else ids).tobytes()

    def _counts(self, words: list[str]) -> Iterator[int]:
        """Each word's initial symbols minus merges."""
        for ids, live in self._symbols(words):
            yield len(ids) - self.merge(ids, live)

    @staticmethod
    def _looked_up(memo: Recent, make, words: list[str]) -> list:
        """What `make` gives for every one of distinct `words`, by the memo where it has it."""
        got = list(map(memo.young.get, words))
        if None in got:
            got = [memo[w] if g is None else g for w, g in zip(words, got)]
            missed = [w for w, g in zip(words, got) if g is None]
            for at in range(0, len(missed), 65_536):  # bounded lists of symbols
                for w, g in zip(part := missed[at : at + 65_536], make(part)):
                    memo[w] = g
            got = [memo[w] if g is None else g for w, g in zip(words, got)]
        return got

    def _cut(self, text: str) -> Iterator[str]:
        """Pre-tokens and special tokens of a text."""
        for i, part in enumerate(self.at_special.split(text) if self.at_special else (text,)):
            if i % 2:
                yield part
            elif part:
                yield from self.pre_tokens.findall(part)

    def _columns(self, texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
        """(pieces of each text as places in a list, pre-tokens of each distinct piece) of `texts` without nulls.

        A blank or line break always starts a piece, unless it stands inside a run of white space; texts with such
        runs, or with a special token's string, are one piece."""
        odd = pc.match_substring_regex(texts, self.odd)
        marked = pc.if_else(odd, "", texts)
        for mark in (" ", "\n"):
            marked = pc.replace_substring(marked, mark, "\0" + mark)
        lists = pc.split_pattern(marked, "\0")
        pieces = lists.flatten().dictionary_encode()
        numbers, cut = pieces.indices.to_numpy(), list(map(self.pre_tokens.findall, plain(pieces.dictionary)))
        if pc.any(odd).as_py():
            numbers = numbers.copy()
            for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                numbers[lists.offsets[row].as_py()] = len(cut)  # an odd text has one empty piece so far
                cut.append(list(self._cut(texts[row].as_py())))
        ends = np.zeros(len(cut) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, cut), np.int32, len(cut)), out=ends[1:])
        words = pa.ListArray.from_arrays(pa.array(ends), pa.array(chain.from_iterable(cut), pa.string()))
        return pa.ListArray.from_arrays(lists.offsets, pa.array(numbers)), words

    def _of_words(self, memo: Recent, make, words: pa.ListArray) -> tuple[list, pa.Array]:
        """Values of distinct pre-tokens, and which of them each pre-token is."""
        coded = words.flatten().dictionary_encode()
        return self._looked_up(memo, make, plain(coded.dictionary)), coded.indices

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each row without nulls."""
        pieces, words = self._columns(texts)
        packed, which = self._of_words(self.words, self._packed, words)
        by_piece = joined(words.offsets, pa.array(packed, pa.binary()).take(which))
        whole = joined(pieces.offsets, by_piece.take(pieces.flatten()))
        ends = np.zeros(len(whole) + 1, np.int32)
        np.cumsum(pc.binary_length(whole).to_numpy() // 4, out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, whole.buffers()[2]]))

    def digest_column(self, texts: pa.Array) -> tuple[pa.Array, list[str], list[str]]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text, for each row without nulls."""
        ids = self.encode_column(texts)
        named = joined(ids.offsets, self.names.take(ids.flatten()))
        return pc.list_value_length(ids), [hashlib.sha256(memoryview(x.as_buffer())[1:]).hexdigest() for x in named], [hashlib.sha256(x).hexdigest() for x in self.decoded(ids)]

    def count_column(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each row without nulls; makes no ids."""
        pieces, words = self._columns(texts)
        counts, which = self._of_words(self.sizes, self._counts, words)
        by_piece = _sums(words.offsets, np.array(counts, np.int64)[which.to_numpy()])
        return _sums(pieces.offsets, by_piece[pieces.flatten().to_numpy()])

    def decoded(self, ids: pa.ListArray) -> Iterator[pa.Buffer | bytes]:
        """Vocabulary strings of each row concatenated, in UTF-8; bytes that are none become U+FFFD."""
        for x in joined(ids.offsets, self.strings.take(ids.flatten())):
            raw = x.as_buffer()
            try:
                str(raw, "utf-8")
                yield raw
            except UnicodeDecodeError:
                yield str(raw, "utf-8", "replace").encode()


def joined(offsets: pa.Array, values: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), b"")


def _sums(offsets: pa.Array, values: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    upto = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=upto[1:])
    return np.diff(upto[offsets.to_numpy()])


def model_for(data: bytes) -> BytePairModel:
    """One model a worker process."""
    return worker_model(f"bytes {hashlib.md5(data).hexdigest()}", lambda: BytePairModel(data))


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def encode_table(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row: (id, ids array<int>, decoded string)."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        model = model_for(data.value)
        for batch in small_batches(batches):
            ids = model.encode_column(_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([str(x, "utf-8") for x in model.decoded(ids)], pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: `encode_table` without carrying the ids."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        model = model_for(data.value)
        for batch in small_batches(batches):
            n, ids, decoded = model.digest_column(_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), n.cast(pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, vocabulary: bytes, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        model = model_for(data.value)
        for batch in small_batches(batches):
            texts = _texts(batch.column(1))
            n = model.count_column(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
