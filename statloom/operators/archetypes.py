"""Style archetypes: standardised involvement rates, k-means, silhouettes and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.rank import medians
from statloom.sources.payload import written


def standardise(rates: DataFrame, n_components: int) -> DataFrame:
    """(entity_id, component, x, z) of entities with every component; population sd, zero sd counts as 1."""
    whole = rates.filter("x is not null").groupBy("entity_id").agg(F.count("*").alias("n")).filter(F.col("n") == n_components).select("entity_id")
    use = rates.join(whole, "entity_id", "left_semi")
    stats = use.groupBy("component").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return use.join(F.broadcast(stats), "component").select("entity_id", "component", "x", ((F.col("x") - F.col("m")) / F.when(F.col("s") > 1e-12, F.col("s")).otherwise(1.0)).alias("z"))


def centroids(z: DataFrame, membership: DataFrame) -> DataFrame:
    return z.join(membership, "entity_id").groupBy("cluster", "component").agg(F.avg("z").alias("c"))


def assign(z: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest centroid, ties to the smaller cluster; centroids are k times the number of components, broadcast."""
    d = z.join(F.broadcast(centres), "component").groupBy("entity_id", "cluster").agg(F.sum(F.pow(F.col("z") - F.col("c"), 2)).alias("d2"))
    return d.groupBy("entity_id").agg(F.min_by("cluster", F.struct(F.round("d2", 9), "cluster")).alias("cluster"), F.min("d2").alias("d2"))


def silhouette(z: DataFrame, membership: DataFrame) -> DataFrame:
    """Mean silhouette by squared distances, one row, in time linear in entities.

    The squared distances of x to a cluster of n with sum S and sum of squares Q add up to n x^2 - 2 x S + Q, so a row a
    cluster and component, broadcast, stands for its members. A cluster of one and a lone cluster count 0."""
    rows = z.join(membership.select("entity_id", "cluster"), "entity_id")
    sums = rows.groupBy(F.col("cluster").alias("cb"), "component").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    far = F.col("n") * F.col("z") * F.col("z") - 2 * F.col("z") * F.col("s") + F.col("q")
    d = rows.join(F.broadcast(sums), "component").groupBy("entity_id", "cluster", "cb").agg(F.sum(far).alias("d"), F.first("n").alias("n"))
    own = F.col("cb") == F.col("cluster")
    s = d.groupBy("entity_id").agg(F.max(F.when(own, F.col("d") / F.when(F.col("n") > 1, F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    return s.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))).alias("silhouette"))


def euclidean_silhouette(z: DataFrame, membership: DataFrame, block: int = 1024) -> DataFrame:
    """Mean Euclidean silhouette, one row; exact, of any population.

    Blocks of entities meet each other block as arrays, and only sums of distances for each entity and cluster leave
    a pair of blocks, so no row is made for a pair of entities; a task holds one pair of blocks, the arithmetic grows with the square of entities."""
    rows = z.join(membership, "entity_id").groupBy("entity_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "z"))), lambda x: x["z"]).alias("v"))
    # blocks of about `block` entities by hash
    n_blocks = max(1, -(-membership.count() // block))
    blocks = rows.groupBy(F.pmod(F.xxhash64("entity_id"), F.lit(n_blocks)).alias("k")).agg(F.collect_list("entity_id").alias("ids"), F.collect_list("cluster").alias("cs"), F.flatten(F.collect_list("v")).alias("vs"))
    blocks = written(blocks.drop("k").repartition(n_blocks), "parquet")  # made once, in even files
    other = blocks.select(F.col("cs").alias("cs2"), F.col("vs").alias("vs2"))
    pairs = blocks.crossJoin(other).select("ids", "cs", "vs", "cs2", "vs2")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, own, x, c, y = (np.asarray(batch.column(k)[i].values) for k in range(5))
                x, y = x.reshape(len(ids), -1), y.reshape(len(c), -1)
                d = np.sqrt(sum((x[:, k, None] - y[None, :, k]) ** 2 for k in range(x.shape[1])))
                for cb in np.unique(c):
                    mine = c == cb
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), pa.array(np.full(len(ids), cb)), pa.array(d[:, mine].sum(1)), pa.array(np.full(len(ids), mine.sum(), np.int64))], ["entity_id", "cluster", "cb", "s", "n"])

    kinds = {c: membership.schema[c].dataType.simpleString() for c in ("entity_id", "cluster")}
    sums = pairs.mapInArrow(run, f"entity_id {kinds['entity_id']}, cluster {kinds['cluster']}, cb {kinds['cluster']}, s double, n bigint")
    means = sums.groupBy("entity_id", "cluster", "cb").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("cb") == F.col("cluster")
    s = means.groupBy("entity_id").agg(F.max(F.when(own, F.col("s") / F.when(F.col("n") > 1, F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    return s.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))).alias("silhouette"))


PRIME = 2147483647
ROUNDS = 10


def seed_order(entity: np.ndarray, k: int, start: int, seed: int) -> np.ndarray:
    """A number of each entity for model (k, start); the k smallest are its first centres. Whole numbers, so that any engine gets them."""
    x = (entity % PRIME * 69621 + start * 1000003 + k * 7919 + seed) % PRIME
    for r in (1, 2):
        x = (x * x + (12345 + 777 * r)) % PRIME
    return x


def _places(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row of x (ties to the first, distances to 9 digits), and its squared distance."""
    d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    at = np.round(d, 9).argmin(1)
    return at, d[np.arange(len(x)), at]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("entity_id").to_numpy(zero_copy_only=False), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit_kmeans(z: DataFrame, k_values: tuple[int, ...] = (3, 4, 5, 6), starts: int = 25, seed: int = 20260101, rounds: int = ROUNDS) -> DataFrame:
    """(entity_id, cluster, k): of each k the start of least cost after `rounds` rounds, and of those the k of the best silhouette.

    All models take each round together: every task holds all centres (at most the sum of k_values times `starts` rows,
    whatever the input), sums its entities by model and cluster, and a few hundred rows a task are added up. Costs are
    compared to 6 digits and squared silhouettes to 4; ties go to the smaller start and k. A cluster that loses all members
    keeps its centre. Too few entities for the largest k and one more give no rows."""
    ids = z.schema["entity_id"].dataType.simpleString()
    wide = z.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "z"))), lambda x: x["z"]).alias("v"))
    x = written(wide, "parquet")
    models = [(k, s) for k in k_values for s in range(starts)]

    def first(batches):
        best: dict[int, list] = {m: [] for m in range(len(models))}
        for entity, v in _vectors(batches):
            for m, (k, s) in enumerate(models):
                h = seed_order(entity.astype(np.int64), k, s, seed)
                near = np.lexsort((entity, h))[:k]
                best[m] = sorted([*best[m], *((int(h[i]), int(entity[i]), v[i].tolist()) for i in near)])[:k]
        rows = [(m, *r) for m, found in best.items() for r in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["m", "h", "e", "v"])

    found = x.mapInArrow(first, "m int, h bigint, e bigint, v array<double>").groupBy("m").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "e", "v"))), 1, max(k_values)).alias("x"))
    chosen = {r.m: [list(e.v) for e in r.x] for r in found.collect()}  # a row a model
    if x.limit(max(k_values) + 2).count() <= max(k_values) + 1:
        return x.sparkSession.createDataFrame([], f"entity_id {ids}, cluster int, k int")
    centres = [np.array(chosen[m][: models[m][0]]) for m in range(len(models))]

    def totals(which: list[int], spread: bool = False) -> dict[tuple[int, int], tuple]:
        """n, sums and cost (or sum of squares) of the members of each model's clusters."""
        now = [centres[m] for m in which]

        def run(batches):
            sums: dict[tuple[int, int], list] = {}
            for _, v in _vectors(batches):
                for m, c in zip(which, now):
                    at, d = _places(v, c)
                    for j in np.unique(at):
                        mine = at == j
                        n, s, q = sums.get((m, j), (0, 0.0, 0.0))
                        sums[m, j] = n + int(mine.sum()), s + v[mine].sum(0), q + float((v[mine] ** 2).sum() if spread else d[mine].sum())
            keys = list(sums)
            cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].tolist() for k in keys], pa.list_(pa.float64())), pa.array([sums[k][2] for k in keys], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["m", "j", "n", "s", "q"])

        d = centres[0].shape[1]
        got = x.mapInArrow(run, "m int, j int, n bigint, s array<double>, q double").groupBy("m", "j").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(d))).alias("s"), F.sum("q").alias("q"))
        return {(r.m, r.j): (r.n, np.array(r.s), r.q) for r in got.collect()}  # a row a model and cluster

    every = list(range(len(models)))
    for _ in range(rounds):
        sums = totals(every)
        moved = [np.array([sums[m, j][1] / sums[m, j][0] if (m, j) in sums else c[j] for j in range(len(c))]) for m, c in enumerate(centres)]
        still = all(np.array_equal(a, b) for a, b in zip(moved, centres))
        centres[:] = moved
        if still:
            break
    cost: dict[int, float] = {}
    for (m, _), (_, _, q) in totals(every).items():
        cost[m] = cost.get(m, 0.0) + q
    heads = [min((m for m in every if models[m][0] == k), key=lambda m: (round(cost[m], 6), m)) for k in k_values]
    scores = _scores(x, heads, centres, totals(heads, spread=True))
    head = max(heads, key=lambda m: (round(scores[m], 4), -models[m][0]))
    best, k = centres[head], models[head][0]

    def place(batches):
        for entity, v in _vectors(batches):
            yield pa.RecordBatch.from_arrays([pa.array(entity), pa.array(_places(v, best)[0], pa.int32()), pa.array(np.full(len(entity), k), pa.int32())], ["entity_id", "cluster", "k"])

    return x.mapInArrow(place, f"entity_id {ids}, cluster int, k int")


def _scores(x: DataFrame, which: list[int], centres: list[np.ndarray], sums: dict[tuple[int, int], tuple]) -> dict[int, float]:
    """Mean squared silhouette of each model, from its clusters' sums."""
    kept = {m: centres[m] for m in which}

    def run(batches):
        total, count = dict.fromkeys(which, 0.0), 0
        for _, v in _vectors(batches):
            count += len(v)
            square = (v**2).sum(1)
            for m, c in kept.items():
                at, _ = _places(v, c)
                d = np.full((len(v), len(c)), np.inf)
                sizes = np.array([sums.get((m, j), (0, 0, 0))[0] for j in range(len(c))])
                for j in np.nonzero(sizes)[0]:
                    n, s, q = sums[m, j]
                    d[:, j] = n * square - 2 * v @ s + q
                own = np.arange(len(v))
                a = d[own, at] / np.maximum(sizes[at] - 1, 1)
                d[own, at] = np.inf
                b = (d / np.maximum(sizes, 1)).min(1)
                alone = (sizes[at] == 1) | ~np.isfinite(b)
                top = np.where(alone, 1.0, np.maximum(a, b))
                total[m] += float(np.where(alone | (top == 0), 0.0, (np.where(alone, 0.0, b) - a) / np.where(top == 0, 1.0, top)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([total[m] for m in which], pa.float64()), pa.array([count] * len(which), pa.int64())], ["m", "s", "n"])

    return {r.m: r.s / r.n for r in x.mapInArrow(run, "m int, s double, n bigint").groupBy("m").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}


def profiles(z: DataFrame, membership: DataFrame, scores: DataFrame) -> DataFrame:
    """(cluster, component, size, mean_involvement, median_score) of each archetype."""
    members = z.join(membership.select("entity_id", "cluster"), "entity_id").join(scores.select("entity_id", "score"), "entity_id", "left")
    means = members.groupBy("cluster", "component").agg(F.count("*").alias("size"), F.avg("x").alias("mean_involvement"))
    return means.join(medians(members, ["cluster", "component"], ["score"]), ["cluster", "component"], "left")


def labels(centres: DataFrame, sizes: DataFrame) -> list[tuple[int, str]]:
    """A label for each of at most a handful of centroids, larger clusters first; parameters, not data."""
    rows: dict[int, dict[str, float]] = {}
    for r in centres.collect():
        rows.setdefault(r.cluster, {})[r.component] = r.c
    used, out = set(), []
    for r in sizes.orderBy(F.desc("size"), "cluster").collect():
        own = rows[r.cluster]
        high = [c for c, v in sorted(own.items(), key=lambda x: (-x[1], x[0])) if v >= 0.5]
        name = next((f"High {c}" for c in high if f"High {c}" not in used), None)
        if name is None and high:  # every matching name is taken: the strongest once more
            name = f"High {high[0]} (Secondary)"
        elif name is None:
            name = "Low involvement" if sum(v <= -0.35 for v in own.values()) >= 3 else "Balanced"
        used.add(name)
        out.append((r.cluster, name))
    return out


def availability(z: DataFrame, most: int = 6) -> DataFrame:
    """(usable, available, reason): whether there are more entities than the largest number of clusters and one."""
    n = F.col("usable")
    return z.agg(F.count_distinct("entity_id").alias("usable")).select("usable", (n > most + 1).alias("available"), F.when(n <= most + 1, F.concat(F.lit("too few entities: "), n.cast("string"), F.lit(f" of {most + 2}"))).alias("reason"))
