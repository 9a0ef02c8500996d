"""Exact top-k search by inner product with pivot tables (operator 8).

1. Of equal candidates the k + 1 of the smallest ids are kept, since no other can be among a row's best k. `PIVOTS`
   vectors, the same for all blocks, are drawn by hash. The table of distances from every vector to every pivot deals
   the candidates, once, into blocks of near ones: by nearest pivot, then by the distance to it.
2. For a query q the largest |d(q, p) - d(x, p)| over the pivots is a lower bound of the distance to x, so
   (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the inner product. Equal queries are asked once, for k + 1
   candidates, of which each row leaves out itself. A query first meets its home, the block whose ranges of pivot
   distances fit it best: candidates are scored in bound order until no bound left reaches the (k + 1)-th best score.
3. That score and the blocks' ranges tell which other blocks may hold better candidates. Only there is the query sent.
   A task holds one block and streams the queries past it, so no candidate is copied; found are the scores that reach
   the query's (k + 1)-th. The best of all blocks are kept, by score and id.

A block holds `most_block` vectors or so and there are at most `MOST_BLOCKS`, whose ranges (under 20 MB) go to every task;
beyond the product of the two, blocks grow. Distances are taken with vectors padded by zeros, which changes none
between vectors of one length. Components become floor(scale * x); scores are whole numbers, computed in doubles while
those are exact and in Python integers beyond (cut to 64 bits).

Defined results: a vector that is null or holds a null or a non-finite component takes no part; vectors meet those of
their own length; a row never meets itself, but other rows of its id, equal ones too; rows that repeat a query are
answered each; a null id counts as the largest in ties and is no query; ties go to the smaller id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import stored

PIVOTS = 16
STEP = 512
MOST_BLOCKS = 65_536
#: Stands for a null id inside blocks.
NULL = 2**63 - 1
LEAST, MOST = -(2**63), 2**63 - 1
#: The query, a candidate's id, whether the two vectors are equal, and the score.
FOUND = "q bigint, vec_id bigint, same boolean, score bigint"
#: Far above the rounding of distances and sums of squares, relative to them.
ROUNDING = 1e-12


def quantized(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<bigint>) of the vectors that take part."""
    x = F.col(vec_col)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(sound).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def _by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their components as a matrix."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    at = [np.flatnonzero(sizes == n) for n in np.unique(sizes)]
    return [(rows, flat[offsets[rows][:, None] + np.arange(sizes[rows[0]])]) for rows in at]


def distances(x: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """A row for each pivot: its distances from the rows of `x`, the shorter side padded by zeros."""
    n, out = x.shape[1], np.empty((len(pivots), len(x)))
    for row, p in zip(out, pivots):
        gap = x - np.pad(p[:n], (0, max(0, n - len(p))))
        np.sqrt((gap * gap).sum(1) + (p[n:] * p[n:]).sum(), out=row)
    return out


def _wide(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Block:
    """Candidates of one length and their table of pivot distances."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: list[np.ndarray]):
        self.ids, self.x, self.pivots, self.wide = ids, x, pivots, _wide(x)
        self.fx = x.astype(np.float64)
        self.squares = (self.fx * self.fx).sum(1)
        self.table = distances(self.fx, pivots)
        self.far = self.table.max(initial=0)

    def best(self, q: np.ndarray, k: int, least: np.ndarray):
        """For each query, the places and scores of its best k candidates that score its `least` or more."""
        fq = q.astype(np.float64)
        mine, squares = distances(fq, self.pivots).T, (fq * fq).sum(1)
        bound, gap = np.empty(len(self.fx)), np.empty(len(self.fx))
        for i, v in enumerate(q):
            if max(self.wide, _wide(v)) ** 2 * len(v) >= 2**48:  # below it squared distances are exact
                yield self._exact(v, k, least[i])
                continue
            bound.fill(0)
            for to, d in zip(self.table, mine[i]):
                np.maximum(bound, np.abs(np.subtract(to, d, out=gap), out=gap), out=bound)
            np.maximum(np.subtract(bound, ROUNDING * (mine[i].max(initial=0) + self.far), out=bound), 0, out=bound)
            np.multiply(bound, bound, out=bound)
            upper = np.subtract(self.squares, bound, out=bound)
            upper += squares[i]
            upper /= 2
            upper += 1  # above the rounding of squares
            yield self._ordered(fq[i], k, int(least[i]), upper)

    def _ordered(self, q: np.ndarray, k: int, least: int, upper: np.ndarray):
        """The best bounds first, until no bound left reaches the k-th best score."""
        left = np.flatnonzero(upper >= least)
        best, scores, step = np.zeros(0, np.int64), np.zeros(0, np.int64), STEP
        while len(left):
            if len(left) > step:
                chosen = np.argpartition(upper[left], len(left) - step)
                some, left = left[chosen[-step:]], left[chosen[:-step]]
            else:
                some, left = left, left[:0]
            got = (self.fx[some] @ q).astype(np.int64)
            high = got >= least
            best, scores = np.r_[best, some[high]], np.r_[scores, got[high]]
            first = np.lexsort((self.ids[best], -scores))[:k]
            best, scores = best[first], scores[first]
            if len(best) == k:
                least = max(least, int(scores[-1]))
                left = left[upper[left] >= least]
            step *= 4
        return best, scores

    def _exact(self, v: np.ndarray, k: int, least: int):
        scores = np.array([max(LEAST, min(MOST, int(s))) for s in self.x.astype(object) @ v.astype(object)], np.int64)
        left = np.flatnonzero(scores >= least)
        left = left[np.lexsort((self.ids[left], ~scores[left]))][:k]  # ~x falls as x rises, without overflow
        return left, scores[left]


def _measured(pivots: list[np.ndarray]):
    """Adds squared length, pivot distances, and the nearest pivot with its distance."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            square, d = np.zeros(n), np.zeros((n, len(pivots)))
            for rows, x in _by_length(batch.column("v")):
                x = x.astype(np.float64)
                square[rows], d[rows] = (x * x).sum(1), distances(x, pivots).T
            cell = d.argmin(1)
            table = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(pivots), d.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(square), table, pa.array(cell, pa.int32()), pa.array(d[np.arange(n), cell])], [*batch.schema.names, "square", "d", "cell", "ring"])

    return run


def _scan(pivots: list[np.ndarray], k: int):
    """Rows come by block, candidates (kind 0) before queries (kind 1): one block is held, its queries stream past."""

    def run(batches):
        block, held, lengths = None, [], {}
        for batch in batches:
            key = batch.column("block").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(key)]):
                part = batch.slice(i, j - i)
                if key[i] // 2 != block:
                    block, held, lengths = key[i] // 2, [], {}
                if key[i] % 2 == 0:
                    held.append(part)
                    continue
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ids = table.column("id").to_numpy()
                    lengths = {x.shape[1]: Block(ids[at], x, pivots) for at, x in _by_length(table.column("v").chunk(0))}
                    held = []
                number, least, found = part.column("id").to_numpy(), part.column("least").fill_null(LEAST).to_numpy(), []
                for at, q in _by_length(part.column("v")):
                    if own := lengths.get(q.shape[1]):
                        for a, v, (best, scores) in zip(at, q, own.best(q, k, least[at])):
                            found.append((np.full(len(best), number[a]), own.ids[best], (own.x[best] == v).all(1), scores))
                columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "vec_id", "same", "score"])

    return run


class Ranges:
    """The blocks' ranges of pivot distances, lengths and squares: a row a block."""

    def __init__(self, table: pa.Table, n_pivots: int):
        column = lambda c: table.column(c).to_numpy()
        self.low, self.high = ([column(f"{side}{p}") for p in range(n_pivots)] for side in ("low", "high"))
        self.blocks, self.most, self.shortest, self.longest = column("block"), column("most"), column("shortest"), column("longest")
        self.far = max((h.max(initial=0) for h in self.high), default=0)

    def gaps(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of each query's distance to each block, and whether lengths allow a meeting."""
        d = batch.column("d").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(self.low))
        gap = np.zeros((batch.num_rows, len(self.blocks)))
        for p in range(len(self.low)):
            np.maximum(gap, self.low[p] - d[:, p, None], out=gap)
            np.maximum(gap, d[:, p, None] - self.high[p], out=gap)
        size = batch.column("size").to_numpy()[:, None]
        return np.maximum(gap - ROUNDING * (d.max(1, initial=0)[:, None] + self.far), 0), (self.shortest <= size) & (size <= self.longest)

    def slices(self, batches):
        step = max(1, (4 << 20) // max(1, len(self.blocks)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def homes(self, batches):
        """Adds each query's home."""
        for batch in self.slices(batches):
            gap, meets = self.gaps(batch)
            home = self.blocks[np.where(meets, gap, np.inf).argmin(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], [*batch.schema.names, "block"])

    def reach(self, batches):
        """Sends each query to the blocks, other than its home, that may hold a score of `least` or more."""
        for batch in self.slices(batches):
            gap, meets = self.gaps(batch)
            total = batch.column("square").to_numpy()[:, None] + self.most
            upper = np.maximum((total - gap * gap) / 2 + 1 + ROUNDING * total, float(LEAST))
            meets &= (upper >= batch.column("least").fill_null(LEAST).to_numpy()[:, None]) & (batch.column("block").to_numpy()[:, None] != self.blocks)
            query, to = np.nonzero(meets)
            for i in range(0, len(query), 10_000):
                rows = batch.take(pa.array(query[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(self.blocks[to[i : i + 10_000]], pa.int32()), *(rows.column(c) for c in ("id", "v", "least"))], ["block", "id", "v", "least"])


def n_blocks(n: int, least_block: int, most_block: int) -> int:
    """64 blocks, fewer where they would hold under `least_block` vectors, more where over `most_block`."""
    return max(1, min(MOST_BLOCKS, max(-(-n // most_block), min(64, -(-n // least_block)))))


MEASURED = "id bigint, v array<bigint>, size int, square double, d array<double>, cell int, ring double"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, least_block: int = 4_096, most_block: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score) over `vectors` (id, v) for rows where `is_query` of id holds."""
    asked = vectors.filter(is_query & F.col("id").isNotNull()).select("id", "v")
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    vectors = vectors.select(F.coalesce("id", F.lit(NULL)).alias("id"), "v")
    candidates = vectors.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).select("id", "v")
    hashed = F.xxhash64("v")
    drawn = vectors.groupBy(F.pmod(hashed, F.lit(PIVOTS)).alias("of")).agg(F.min_by("v", hashed).alias("v"), F.count("*").alias("n")).collect()  # a vector a group, however often it is repeated
    pivots = [np.array(r.v, np.float64) for r in sorted(drawn, key=lambda r: r.of)] or [np.zeros(0)]
    n = n_blocks(sum(r.n for r in drawn), least_block, most_block)

    def measured(df: DataFrame) -> DataFrame:
        return df.withColumn("size", F.size("v")).mapInArrow(_measured(pivots), MEASURED)

    dealt = measured(candidates).repartitionByRange(n, "size", "cell", "ring", "id")
    table = stored(dealt.select("id", "v", "size", "square", "d", F.spark_partition_id().alias("block")), "vectors")
    ends = [f(F.col("d")[p]).alias(f"{side}{p}") for p in range(len(pivots)) for side, f in (("low", F.min), ("high", F.max))]
    ranges = Ranges(table.groupBy("block").agg(F.max("square").alias("most"), F.min("size").alias("shortest"), F.max("size").alias("longest"), *ends).toArrow(), len(pivots))

    def met(queries: DataFrame) -> DataFrame:
        columns = ("block", "kind", "id", "v", "least")
        held = table.withColumns({"kind": F.lit(0), "least": F.lit(None).cast("bigint")}).select(*columns)
        both = held.unionByName(queries.withColumn("kind", F.lit(1)).select(*columns))
        return both.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(_scan(pivots, k + 1), FOUND)

    numbered = asked.select("v").distinct().withColumn("id", F.monotonically_increasing_id()).select("id", "v")
    queries = stored(measured(numbered).drop("cell", "ring").mapInArrow(ranges.homes, MEASURED.replace("cell int, ring double", "block int")), "queries")
    near = stored(met(queries.withColumn("least", F.lit(None).cast("bigint"))), "near")
    kth = near.groupBy(F.col("q").alias("id")).agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
    far = met(queries.join(kth, "id", "left").mapInArrow(ranges.reach, "block int, id bigint, v array<bigint>, least bigint"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = near.unionByName(far).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "same", "score"))).alias("best"))  # k + 1 at most
    answers = asked.join(queries.select(F.col("id").alias("q"), "v").join(lists, "q"), "v")
    # of rows alike in id and vector any may stand for the query's own
    own = F.array_position(F.transform("best", lambda b: b["same"] & (b["vec_id"] == F.col("id"))), True)
    others = F.filter("best", lambda b, i: i + 1 != F.col("_own"))
    out = answers.withColumn("_own", own).select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("_at", "_b"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), F.nullif("_b.vec_id", F.lit(NULL)).alias("vec_id"), "_b.score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
