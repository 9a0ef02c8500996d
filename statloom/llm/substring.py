"""Repeated passages across documents by phrase automata (operator 7).

A window is `window` consecutive words; each word covered by a window whose word sequence starts earlier (smaller
document id, or same document and earlier start) is removed. Steps, over whole texts:

1. Map, the only pass that looks for phrases: a phrase is half a window's words, its key the letters that stand for
   them (a few bits of each word's hash). Each window's anchor is its phrase with the least mixed key, so equal windows
   have equal anchors and only about one phrase in six is an anchor. Documents are also cut, by content, into segments
   of consecutive windows, told by digest. One shuffle by key confirms the phrases and segments that occur twice.
2. Documents are dealt into blocks of bounded size, packed and compressed; confirmed phrases and segments go to the
   blocks that hold them, at most one row for a block however often it holds them.
3. For each block an Aho-Corasick automaton is compiled from its shard of the confirmed phrases, and all its documents
   stream through it. Its hits are the occurrences: a window whose anchor is not hit goes no further. Segments all of
   whose windows are hit and that are equal to an earlier one are settled: their windows start earlier there. The other
   windows' 96-bit digests are reduced to one row for a block.
4. Digests seen twice are confirmed; their first place goes back to the blocks, where every window with a confirmed
   digest, or in a settled segment, that is not at its first place is removed.

No step brings a group's rows together: a passage that a third of all documents share costs each block one row.
Hashes are of exact words; two different windows are taken for equal with probability about 2^-96 a pair.

Defined results: null text has no words; a null id counts as the largest; rows that repeat an id stand at the same
place, so neither removes the other (rows alike in id and text share a block); texts under `window` words stay whole;
empty table, empty result.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import opened, packed_blocks, release, salt, small_batches

BASES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25))
LONGEST = 256
#: Bits of a letter, and letters of a phrase's key.
LETTER, KEY = 6, 10
NONE = np.uint64(2**64 - 1)
HALF = np.uint64(32)
LAST = 2**63 - 1
BLOCK_BYTES = 8 << 20
ADDED = ("n_words", "n_removed", "kept_text")


def rolling(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Digest of each `width` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= base
        out += hashes[j : j + n]
    out ^= out >> np.uint64(29)
    return out * BASES[2]


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of two bases and of their inverses modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS.clear()
        for base in BASES[:2]:
            pair = []
            for x in (int(base), pow(int(base), -1, 2**64)):
                out = np.full(n, x, np.uint64)
                out[0] = 1
                pair.append(np.multiply.accumulate(out))
            _POWERS.append(tuple(pair))
    return _POWERS


def _mixed(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    h ^= size.astype(np.uint64) << np.uint64(56)
    for shift in (33, 29, 32):
        h ^= h >> np.uint64(shift)
        h *= BASES[2]
    return h


def word_hashes(text: bytes, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes and the first byte of each word, from prefix sums; about `most` bytes at a time."""
    first, second, places, at = [], [], [], 0
    while at < len(text):
        end = len(text)
        if end - at > most:
            end = at + most
            while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        raw = np.frombuffer(text, np.uint8, end - at, at)
        black = np.zeros(len(raw) + 2, bool)
        black[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.flatnonzero(black[1:] != black[:-1])
        begin, stop = edge[::2], edge[1::2]
        wide = raw.astype(np.uint64) + np.uint64(1)
        for out, (power, inverse) in zip((first, second), _powers(max(most, len(raw)) + 1)):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(wide * power[: len(raw)], out=sums[1:])
            out.append(_mixed((sums[stop] - sums[begin]) * inverse[begin], stop - begin))
        places.append(begin + at)
        at = end
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(first) if first else empty, np.concatenate(second) if second else empty, np.concatenate(places) if places else np.zeros(0, np.int64))


class Flat:
    """The words of many documents in one array, and what is asked of their windows."""

    def __init__(self, texts: list[str | None], ids: list[int | None], window: int):
        self.texts = [(t or "").encode() for t in texts]
        self.values, self.others, place = word_hashes(b"\n".join(self.texts))
        offset = np.cumsum([len(t) + 1 for t in self.texts])
        self.doc = np.searchsorted(offset, place, "right")
        self.size = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.window, self.phrase = window, min(KEY, max(1, window // 2))
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        n = len(self.values)
        m = max(0, n - window + 1)
        self.whole = self.end[self.doc[:m]] - np.arange(m) >= window if m else np.zeros(0, bool)
        self.starts = np.flatnonzero(self.whole)

    def letters(self) -> np.ndarray:
        """The letters of each word, one or (of short phrases) several."""
        return np.stack([(self.values >> np.uint64(LETTER * i)) & np.uint64(2**LETTER - 1) for i in range(KEY // self.phrase)], 1).astype(np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each phrase's key, its mixed key, and the least mixed key of each window."""
        n = max(0, len(self.values) - self.phrase + 1)
        key = np.zeros(n, np.uint64)
        letters = self.letters()
        for j in range(self.phrase):
            for column in letters.T:
                key <<= np.uint64(LETTER)
                key |= column[j : j + n]
        mixed = key * BASES[0]
        mixed ^= mixed >> np.uint64(32)
        mixed *= BASES[1]
        return key, mixed, self._least(mixed)

    def _least(self, mixed: np.ndarray) -> np.ndarray:
        m = len(self.whole)
        out = mixed[:m].copy()
        for j in range(1, self.window - self.phrase + 1 if m else 0):
            np.minimum(out, mixed[j : j + m], out=out)
        return out

    def anchor_places(self, mixed: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of the phrases that are some window's anchor."""
        m, chosen = len(self.whole), np.zeros(len(mixed), bool)
        for j in range(self.window - self.phrase + 1 if m else 0):
            chosen[j : j + m] |= self.whole & (mixed[j : j + m] == least)
        return np.flatnonzero(chosen)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        return rolling(self.values, self.window, BASES[0])[self.starts], rolling(self.others, self.window, BASES[1])[self.starts]

    def segments(self, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window (as a place in `starts`) and digest pair of each segment of windows."""
        n = len(self.starts)
        if not n:
            z = np.zeros(0, np.uint64)
            return np.zeros(0, np.int64), z, z
        doc = self.doc[self.starts]
        cut = d1 % np.uint64(48) == 0
        cut[0] = True
        cut[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(cut)
        far = np.arange(n) - np.repeat(at, np.diff([*at, n]))
        cut |= far % LONGEST == 0
        at = np.flatnonzero(cut)
        far = np.arange(n) - np.repeat(at, np.diff([*at, n]))
        size = np.diff([*at, n]).astype(np.uint64)
        power = np.ones((2, LONGEST), np.uint64)
        for i in range(1, LONGEST):
            power[:, i] = power[:, i - 1] * np.array(BASES[:2])
        return at, np.add.reduceat(d1 * power[0][far], at) + size, np.add.reduceat(d2 * power[1][far], at) ^ size

    def hits(self, automaton: ahocorasick.Automaton) -> np.ndarray:
        """Whether each window of `starts` has its anchor at a place where the automaton finds a confirmed phrase."""
        each, size = KEY // self.phrase, KEY // self.phrase * self.phrase
        ends = np.fromiter((e for e, _ in automaton.iter(_ascii(self.letters()))), np.int64)
        hit = np.zeros(len(self.values), bool)
        hit[(ends[(ends + 1) % each == 0] + 1 - size) // each] = True
        _, mixed, least = self.anchors()
        found = np.where(hit[: len(mixed)], mixed, NONE)
        return (self._least(found) == least)[self.starts]


def _ascii(letters: np.ndarray) -> str:
    return (letters + np.uint8(48)).tobytes().decode("ascii")


def compiled(keys: np.ndarray, phrase: int) -> ahocorasick.Automaton | None:
    """The automaton of the phrases with these keys."""
    size = KEY // phrase * phrase
    flat = _ascii(np.stack([(keys >> np.uint64(LETTER * (size - 1 - i))) & np.uint64(2**LETTER - 1) for i in range(size)], 1).astype(np.uint8))
    automaton = ahocorasick.Automaton()
    for at in range(0, len(flat), size):
        automaton.add_word(flat[at : at + size], 1)
    automaton.make_automaton()
    return automaton if len(keys) else None


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


BATCH = 2 << 20


FACT = "kind tinyint, a bigint, b bigint, block int, doc bigint, start bigint, n bigint"
PHRASE, SEGMENT, WINDOW = 0, 1, 2
ROW = np.dtype([("a", "u8"), ("b", "u8"), ("block", "i4"), ("doc", "i8"), ("start", "i8"), ("n", "i8")])


def _facts(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    """`rows` with one row for each (a, b, block): the number of its rows and their first place."""
    if len(rows):
        rows = rows[np.lexsort((rows["start"], rows["doc"], rows["b"], rows["block"], rows["a"]))] if kind else rows[np.lexsort((rows["block"], rows["a"]))]
        new = np.flatnonzero(np.r_[True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]) | (rows["block"][1:] != rows["block"][:-1])])
        n = np.add.reduceat(rows["n"], new)
        rows = rows[new]
        rows["n"] = n
    columns = [_signed(rows[c]) if c in "ab" else pa.array(rows[c]) for c in ROW.names]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), *columns], ["kind", *ROW.names])


def _recurrences(batches, window):
    """Facts of the anchors' phrases, counted in parts, and of segments."""
    release()
    held: list[np.ndarray] = []
    for batch in small_batches(batches, BATCH):
        flat = Flat(batch.column("_text").to_pylist(), batch.column("_id").to_pylist(), window)
        block = batch.column("_block").to_numpy(zero_copy_only=False)
        key, mixed, least = flat.anchors()
        places = flat.anchor_places(mixed, least)
        rows = np.zeros(len(places), ROW)
        rows["a"], rows["block"], rows["n"] = key[places], block[flat.doc[places]], 1
        held.append(rows)
        if sum(map(len, held)) > 1_000_000:
            yield _facts(PHRASE, np.concatenate(held))
            held.clear()
        at, g1, g2 = flat.segments(*flat.digests())
        start = flat.starts[at]
        doc = flat.doc[start]
        rows = np.zeros(len(at), ROW)
        rows["a"], rows["b"], rows["block"], rows["doc"], rows["start"], rows["n"] = g1, g2, block[doc], flat.ids[doc], start - flat.begin[doc], 1
        yield _facts(SEGMENT, rows)
    if held:
        yield _facts(PHRASE, np.concatenate(held))


def _seen_twice(facts: DataFrame) -> DataFrame:
    """One row for each block of what occurs twice or more in all, with its first place; one shuffle."""
    same = Window.partitionBy("kind", "a", "b")
    all_ = facts.repartition("a").withColumns({"_n": F.sum("n").over(same), "_first": F.min(F.struct("doc", "start")).over(same)}).filter("_n > 1")
    return all_.groupBy("kind", "a", "b", "block").agg(F.min("_first").alias("_first")).select("kind", "a", "b", "block", "_first.doc", "_first.start")


class Known:
    """First places of digest pairs."""

    def __init__(self, table: pa.Table):
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort((column("b").view(np.uint64), column("a").view(np.uint64)))
        self.a, self.b = column("a").view(np.uint64)[order], column("b").view(np.uint64)[order]
        self.doc, self.start = column("doc")[order], column("start")[order]

    def find(self, a, b) -> np.ndarray:
        """The number of each pair, -1 where it isn't known."""
        found = np.full(len(a), -1)
        if not len(self.a):
            return found
        # equal `a` with another `b` is as good as impossible; such runs are walked to their end
        at = np.searchsorted(self.a, a)
        open_ = np.arange(len(a))
        while len(open_):
            i = at[open_]
            ok = i < len(self.a)
            ok[ok] = self.a[i[ok]] == a[open_[ok]]
            open_, i = open_[ok], i[ok]
            same = self.b[i] == b[open_]
            found[open_[same]] = i[same]
            open_ = open_[~same]
            at[open_] += 1
        return found

    def later(self, a, b, doc, start) -> np.ndarray:
        """Whether each pair is known with another first place than (doc, start)."""
        found = self.find(a, b)
        return (found >= 0) & ((self.doc[found] != doc) | (self.start[found] != start)) if len(self.a) else found >= 0


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text: the words left, joined by one space."""
    kept = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(kept)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    blocked = docs.withColumns({"_id": F.col(id_col).cast("bigint"), "_text": F.col(text_col).cast("string"), "_block": salt([F.col(id_col), F.xxhash64(text_col)], n_blocks)})
    read = blocked.select("_id", "_text", "_block")
    known = _seen_twice(read.mapInArrow(lambda b: _recurrences(b, window), FACT))
    packed = blocked.select(*[c for c in kept if c != text_col], "_id", "_text", "_block").mapInArrow(packed_blocks, "block int, blob binary")
    place = lambda flat, start: (flat.ids[flat.doc[start]], start - flat.begin[flat.doc[start]])

    def occurrences(blobs: pa.Table, facts: pa.Table) -> pa.Table:
        release()
        kinds = facts.column("kind").to_numpy()
        automaton = compiled(facts.column("a").to_numpy().view(np.uint64)[kinds == PHRASE], min(KEY, max(1, window // 2)))
        segments, out = Known(facts.filter(pa.array(kinds == SEGMENT))), ([np.zeros(0, ROW)], [np.zeros(0, ROW)])
        block = blobs.column("block")[0].as_py() if blobs.num_rows else 0
        for batch in opened(blobs.column("blob")) if automaton else ():
            for part in small_batches([batch], BATCH):
                flat = Flat(part.column("_text").to_pylist(), part.column("_id").to_pylist(), window)
                if not len(flat.starts):
                    continue
                d1, d2 = flat.digests()
                hit = flat.hits(automaton)
                at, g1, g2 = flat.segments(d1, d2)
                which = segments.find(g1, g2)
                settled = (which >= 0) & np.logical_and.reduceat(hit, at)
                own = which[settled]
                rows = np.zeros(len(own), ROW)
                rows["a"], rows["b"], rows["doc"], rows["start"], rows["n"] = segments.a[own], segments.b[own], segments.doc[own], segments.start[own], 2
                out[0].append(rows)
                doc, start = place(flat, flat.starts[at])
                later = settled & ((segments.doc[which] != doc) | (segments.start[which] != start)) if len(segments.a) else settled
                at = np.flatnonzero(hit & ~np.repeat(later, np.diff([*at, len(hit)])))
                rows = np.zeros(len(at), ROW)
                rows["doc"], rows["start"] = place(flat, flat.starts[at])
                rows["a"], rows["b"], rows["n"] = d1[at], d2[at] >> HALF, 1
                out[1].append(rows)
        for rows in (out := [np.concatenate(x) for x in out]):
            rows["block"] = block
        return pa.Table.from_batches([_facts(SEGMENT, out[0]), _facts(WINDOW, out[1])])

    found = packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(occurrences, FACT)
    marked = _seen_twice(found)
    fields = [f for f in docs.schema.fields if f.name != text_col]

    def cleaned(blobs: pa.Table, facts: pa.Table) -> pa.Table:
        release()
        kinds = facts.column("kind").to_numpy()
        windows, segments = Known(facts.filter(pa.array(kinds == WINDOW))), Known(facts.filter(pa.array(kinds == SEGMENT)))
        out = []
        for batch in opened(blobs.column("blob")):
            for part in small_batches([batch], BATCH):
                flat = Flat(part.column("_text").to_pylist(), part.column("_id").to_pylist(), window)
                gone = np.zeros(len(flat.starts), bool)
                if len(gone):
                    d1, d2 = flat.digests()
                    at, g1, g2 = flat.segments(d1, d2)
                    gone = np.repeat(segments.later(g1, g2, *place(flat, flat.starts[at])), np.diff([*at, len(d1)]))
                    gone |= windows.later(d1, d2 >> HALF, *place(flat, flat.starts))
                cover = np.zeros(len(flat.values) + 1, np.int64)
                cover[flat.starts[gone]] += 1  # starts are distinct
                cover[flat.starts[gone] + window] -= 1
                left = np.cumsum(cover)[:-1] == 0
                stays = np.add.reduceat(np.r_[left, False], np.minimum(flat.begin, len(left)), dtype=np.int64) * (flat.size > 0)
                texts = []
                for text, a, n, stay in zip(flat.texts, flat.begin.tolist(), flat.size.tolist(), stays.tolist()):
                    words = text.split()
                    texts.append(b" ".join(words if stay == n else [words[i] for i in np.flatnonzero(left[a : a + n])]).decode())
                names = [f.name for f in fields]
                out.append(pa.table([*(part.column(c) for c in names), pa.array(flat.size), pa.array(flat.size - stays), pa.array(texts, pa.string())], [*names, *ADDED]))
        return pa.concat_tables(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    empty = to_arrow_schema(schema).empty_table()
    return packed.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(cleaned, schema)
