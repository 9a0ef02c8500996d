import numpy as np

from statloom.operators import archetypes


def brute(x, c, power=0.5):
    out = []
    for i in range(len(x)):
        d = (((x - x[i]) ** 2).sum(1)) ** power
        own = (c == c[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a, b = d[c == c[i]].sum() / (own - 1), min(d[c == k].mean() for k in set(c) - {c[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouette_over_5000_entities_is_exact(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(5200, 3)), rng.integers(0, 4, 5200)
    c[:1] = 7  # a cluster of one
    x += c[:, None]
    rows = [(i, "abc"[k], float(x[i, k])) for i in range(len(x)) for k in range(3)]
    z = spark.createDataFrame(rows, "entity_id long, component string, z double")
    members = spark.createDataFrame([(i, int(k)) for i, k in enumerate(c)], "entity_id long, cluster int")
    got = archetypes.euclidean_silhouette(z, members).first().silhouette
    assert abs(got - brute(x, c)) < 1e-9


def test_squared_silhouette_is_linear_and_exact(spark):
    rng = np.random.default_rng(9)
    x, c = rng.normal(size=(400, 3)), rng.integers(0, 4, 400)
    c[:1] = 7
    z = spark.createDataFrame([(i, "abc"[k], float(x[i, k])) for i in range(len(x)) for k in range(3)], "entity_id long, component string, z double")
    members = spark.createDataFrame([(i, int(k)) for i, k in enumerate(c)], "entity_id long, cluster int")
    got = archetypes.silhouette(z, members)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert abs(got.first().silhouette - brute(x, c, 1)) < 1e-9
    one = archetypes.silhouette(z, members.selectExpr("entity_id", "0 AS cluster")).first().silhouette
    assert one == 0


def lloyd(x, k, start, seed, rounds):
    ids = np.arange(len(x))
    c = x[np.lexsort((ids, archetypes.seed_order(ids, k, start, seed)))[:k]]
    for _ in range(rounds):
        at = ((x[:, None] - c) ** 2).sum(2).round(9).argmin(1)
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
    d = ((x[:, None] - c) ** 2).sum(2)
    at = d.round(9).argmin(1)
    return at, d[ids, at].sum()


def test_all_models_in_one_pass_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 3)) + m for m in (0, 6, 12, 18)])
    z = spark.createDataFrame([(i, "abc"[k], float(x[i, k])) for i in range(len(x)) for k in range(3)], "entity_id long, component string, z double").repartition(5)
    got = {r.entity_id: (r.cluster, r.k) for r in archetypes.fit_kmeans(z, starts=8, seed=5).collect()}
    best = {}
    for k in (3, 4, 5, 6):
        at, _ = min((lloyd(x, k, s, 5, archetypes.ROUNDS) for s in range(8)), key=lambda r: round(r[1], 6))
        best[k] = round(brute(x, at, 1), 4), at
    k = max(best, key=lambda k: (best[k][0], -k))
    assert k == 4 and got == {i: (int(c), k) for i, c in enumerate(best[k][1])}


def test_too_few_entities_have_no_model(spark):
    z = spark.createDataFrame([(i, "a", float(i)) for i in range(7)], "entity_id long, component string, z double")
    assert archetypes.fit_kmeans(z).count() == 0 and archetypes.fit_kmeans(z.limit(0)).count() == 0
