"""Best-fit packing of documents into sequences of at most `capacity` tokens (operator 3).

Lengths are whole numbers from 1 to `capacity`, so the problem is its histogram: at most `capacity` rows reach the
driver whatever the corpus. There, best-fit decreasing over the histogram gives the first incumbent; if it is above
the lower bound (total waste, or the Martello-Toth bound), bin completion goes on: the largest length left gets its
undominated fillings, least waste first, each used as many times as the counts allow, and a branch is cut when bins
used so far plus the bound of what is left reach the incumbent. Two more searches take fillings in depth-first order.
`nodes` bounds each search, `most` and `steps` the fillings of a node; the incumbent stays.
The plan says for each length which ranks go to which bins, and the pieces, ranked per length on the executors, look
their place up. Hot lengths are ranked in salted groups with running offsets.

Defined results: null or empty text is the single end token; a document longer than `capacity` is cut into full
pieces and a rest; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols, joined
from .util import Recent, plain, salt, shuffle_parts, small_batches, stored, worker_model

END = 0
BATCH = 4 << 20
#: Distinct parts of texts whose ids a worker keeps, twice so many at most: about 60 MB.
MEMO = 250_000
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


class ChunkTokenizer:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct part of a blank-free chunk.

    The vocabulary's pre-tokenizer drops white space and its normalizer works within chunks, so a text's ids are
    its chunks' ids in turn. A chunk of Latin-1 characters without an apostrophe or a special token is cut further,
    where the pre-tokenizer cuts it: at runs of letters, single numbers and runs of others, in lower case."""

    #: Latin-1 letters and numbers; all of Latin-1 is in composed form already.
    PARTS = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe\x85\xa0]+")
    WHOLE = re.compile("'|<\\||[^\x00-\xff]")

    def __init__(self, data: bytes, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_buffer(data)
        self.own.no_truncation()
        self.own.no_padding()
        self.merge, self.symbols, self.memo = self.own.model.tokenize, byte_symbols(), Recent(memo)

    def _packed(self, part: str) -> bytes:
        if self.WHOLE.search(part):
            ids = self.own.encode(part, add_special_tokens=False).ids
        else:  # normalized and cut already: straight to the library's merging
            ids = [t.id for t in self.merge(part if part.isascii() and part.isprintable() else "".join(map(self.symbols.__getitem__, part.encode())))]
        return array("I", ids).tobytes()

    def ids(self, texts: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each row without nulls."""
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        own = chunks.dictionary
        whole = pc.match_substring_regex(own, "'|<\\||[^\\x00-\\x{ff}]")
        cut = list(map(self.PARTS.findall, plain(pc.utf8_lower(own))))
        for i in np.flatnonzero(plain(whole)).tolist():
            cut[i] = [own[i].as_py()]
        parts = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        known = plain(parts.dictionary)
        got = list(map(self.memo.young.get, known))
        for i, x in enumerate(known):
            if got[i] is None:
                if (packed := self.memo[x]) is None:
                    packed = self.memo[x] = self._packed(x)
                got[i] = packed
        ends = np.zeros(len(cut) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, cut), np.int32, len(cut)), out=ends[1:])
        by_chunk = joined(pa.array(ends), pa.array(got, pa.binary()).take(parts.indices))
        return joined(lists.offsets, by_chunk.take(chunks.indices))


def pieces(docs: DataFrame, vocabulary: bytes, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for every document, ended by token 0; map only."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = f"chunks {memo} {hashlib.md5(data.value).hexdigest()}"
        own, end = worker_model(key, lambda: ChunkTokenizer(data.value, memo)), np.array([END], "<u4").tobytes()
        for batch in small_batches(batches, BATCH):
            rows: list = []
            for k, ids in enumerate(own.ids(pc.fill_null(batch.column(1).cast(pa.string()), "")).to_pylist()):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, p, at // 4, len(part) // 4, zlib.crc32(part)))
            k, p, start, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {PIECES}")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: total length, and Martello and Toth's bound over every threshold."""
    n, size = np.zeros(capacity + 2, np.int64), np.arange(capacity + 2)
    n[list(counts)] = list(counts.values())
    upto_n, upto = np.cumsum(n), np.cumsum(n * size)  # of lengths up to x
    half = capacity // 2
    k = np.arange(half + 1)  # lengths under k are left out
    long_n = upto_n[capacity] - upto_n[half]
    mid_n, mid = upto_n[capacity - k] - upto_n[half], upto[capacity - k] - upto[half]
    small = upto[half] - np.where(k > 0, upto[np.maximum(k - 1, 0)], 0)
    need = long_n - (-(small - (capacity * mid_n - mid)) // capacity).clip(max=0)
    return int(max(need.max(initial=0), -(-int(upto[capacity]) // capacity)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: (filling, times). Equal bins and equal lengths are handled at once."""
    bins: dict[int, list] = {}
    free: list[int] = []

    def put(room, filling, times):
        if times:
            if room not in bins:
                bins[room] = []
                insort(free, room)
            bins[room].append([filling, times])

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            at = bisect_left(free, x)
            if at == len(free):
                q = min(capacity // x, left)
                put(capacity - q * x, {x: q}, left // q)
                left %= q
                continue
            room = free[at]
            filling, n = bins[room].pop()
            q = min(room // x, left)
            used = min(n, left // q)
            if n > used:
                bins[room].append([filling, n - used])
            if not bins[room]:
                del bins[room], free[at]
            put(room - q * x, {**filling, x: filling.get(x, 0) + q}, used)
            left -= q * used
    return [(filling, n) for room in free for filling, n in bins[room]]


def dominance(counts: dict[int, int], top: int):
    """Whether a length left outside fits a filling's waste, or could replace a smaller one in it."""
    rising = sorted(x for x, n in counts.items() if n)

    def left_between(own, low, high):
        """Whether a length in (low, high] is left outside."""
        for i in range(bisect_left(rising, low + 1), len(rising)):
            if rising[i] > high:
                return False
            if counts[rising[i]] > own.get(rising[i], 0):
                return True
        return False

    return lambda own, waste: waste > 0 and (left_between(own, 0, waste) or any(left_between(own, y, y + waste) for y in own if y != top))


def fillings(counts: dict[int, int], capacity: int, most: int = 12, steps: int = 4000) -> list[dict[int, int]]:
    """Undominated fillings of a bin that holds the largest length, least waste first; `steps` bounds those tried.

    A filling is dominated if a length left outside fits its waste, or could replace a smaller one in it. Which sums
    the lengths from a place on can make is kept as bits of a number, so only fillings of the waste in turn are built.
    Within a waste, fillings with different second lengths take turns."""
    top = max(x for x, n in counts.items() if n)
    space = capacity - top
    free = [(x, m) for x in sorted(counts, reverse=True) if x <= space and (m := counts[x] - (x == top)) > 0]
    reach, every = [1] * (len(free) + 1), (1 << space + 1) - 1
    for i in range(len(free) - 1, -1, -1):
        x, bits, n, k = free[i][0], reach[i + 1], min(free[i][1], space // free[i][0]), 1
        while n:
            k = min(k, n)
            bits |= bits << k * x & every
            n, k = n - k, 2 * k
        reach[i] = bits

    dominated = dominance(counts, top)

    def firsts(at, room):
        """(place, number) of the largest length of each way to fill `room` by the lengths from `at` on."""
        for i in range(max(at, bisect_left(free, -room, key=lambda f: -f[0])), len(free)):
            if not reach[i] >> room & 1:
                return
            x = free[i][0]
            yield from ((i, n) for n in range(min(room // x, free[i][1]), 0, -1) if reach[i + 1] >> room - n * x & 1)

    def exact(at, room):
        """All ways to fill `room` by the lengths from `at` on."""
        if not room:
            yield {}
        else:
            for i, n in firsts(at, room):
                for rest in exact(i + 1, room - n * free[i][0]):
                    yield {free[i][0]: n, **rest}

    def turns(room):
        if not room:
            yield {}
            return
        rows = deque((free[i][0], n, exact(i + 1, room - n * free[i][0])) for i, n in firsts(0, room))
        while rows:
            x, n, rests = rows.popleft()
            if (rest := next(rests, None)) is not None:
                yield {x: n, **rest}
                rows.append((x, n, rests))

    found, spent = [], 0
    for waste in range(space + 1):
        if reach[0] >> space - waste & 1:
            for rest in turns(space - waste):
                spent += 1
                own = {**rest, top: rest.get(top, 0) + 1}
                if not dominated(own, waste):
                    found.append(own)
                if len(found) == most or spent == steps:
                    return found or [own]
    return found


def deep_fillings(counts: dict[int, int], capacity: int, most: int = 12, steps: int = 4000, pool: int = 48) -> list[dict[int, int]]:
    """Undominated fillings of a bin that holds the largest length, in depth-first order; the least waste of the first `pool`.

    These fill up with the largest second lengths, which saves the small ones for later bins."""
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    top, found, spent = lengths[0], [], 0
    dominated = dominance(counts, top)

    def grow(at, room, own):
        nonlocal spent
        spent += 1
        if spent > steps or len(found) >= pool:
            return
        while at < len(lengths) and (lengths[at] > room or own.get(lengths[at], 0) >= counts[lengths[at]]):
            at += 1
        if at == len(lengths):
            if not dominated(own, room):
                found.append((room, own))
            return
        x = lengths[at]
        q = min(room // x, counts[x] - own.get(x, 0))
        for n in range(q, -1, -1):
            grow(at + 1, room - n * x, {**own, x: own.get(x, 0) + n} if n else own)

    grow(0, capacity - top, {top: 1})
    return [own for _, own in sorted(found, key=lambda f: f[0])[:most]]


def plan(counts: dict[int, int], capacity: int, nodes: int = 300) -> list[tuple[dict[int, int], int]]:
    """(filling, times) by bin completion; `nodes` bounds each branch-and-bound search, never the items packed.

    One search branches by `fillings` and, above the bound still, one by `deep_fillings` and one by fewer of them,
    which goes less by waste."""
    best = best_fit(counts, capacity)
    bins, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    for ways in (fillings, deep_fillings, partial(deep_fillings, most=8, steps=800, pool=32)):
        stack, spent = [({x: n for x, n in counts.items() if n}, 0, ())], 0
        while stack and bins > bound and spent < nodes:
            left, used, chosen = stack.pop()
            spent += 1
            rest = best_fit(left, capacity)
            if used + (here := sum(n for _, n in rest)) < bins:
                bins, best = used + here, [*chosen, *rest]
            if not left or used + lower_bound(left, capacity) >= bins:
                continue
            for own in reversed(ways(left, capacity)):
                times = min(left[x] // n for x, n in own.items())
                after = {x: m for x, n in left.items() if (m := n - times * own.get(x, 0))}
                stack.append((after, used + times, (*chosen, (own, times))))
    return best


def places(chosen: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first bin, items a bin, offset) of its share of the plan."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    base = 0
    for filling, times in chosen:
        offset = 0
        for x in sorted(filling, reverse=True):
            n = filling[x]
            out.setdefault(x, []).append((taken.get(x, 0), base, n, offset))
            taken[x] = taken.get(x, 0) + n * times
            offset += n * x
        base += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pack(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id", nodes: int = 300) -> DataFrame:
    """`cut` (from `pieces`) with sequence_id and offset, gapless from 0 in each sequence."""
    spark = cut.sparkSession
    cut = stored(cut, "pieces", batch_bytes=BATCH)
    chosen = plan({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity, nodes)  # at most `capacity` rows
    where = spark.sparkContext.broadcast(places(chosen, capacity))
    salted = cut.withColumn("_salt", salt([F.col(id_col), F.col("piece")], 4 * shuffle_parts(spark)))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")))
    ranked = ranked.join(before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_salt"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))

    def run(frames):
        for f in frames:
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            length, rank = f["length"].to_numpy(), f["_rank"].to_numpy()
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(f) else ():
                table = where.value[int(length[at[0]])]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + k // row[:, 2]
                offset[at] = row[:, 3] + k % row[:, 2] * length[at]
            yield pd.DataFrame({**{c: f[c] for c in f.columns if c != "_rank"}, "sequence_id": sequence, "offset": offset})

    kind = cut.schema[id_col].dataType.simpleString()
    return ranked.mapInPandas(run, f"{id_col} {kind}, {PIECES}, sequence_id bigint, offset bigint")
