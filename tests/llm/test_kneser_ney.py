import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from statloom.llm import kneser_ney as kn


def brute(train, texts, order):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    grams = Counter(kn.normal(t, order)[i : i + order] for t in train for i in range(len(kn.normal(t, order)) - order + 1))
    counts = {order: dict(grams)}
    for n in range(order - 1, 0, -1):
        c = Counter(g[1:] for g in counts[n + 1])
        counts[n] = dict(c)
    d = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        d[n] = [min(max(x, 0), k) for k, x in enumerate(raw, 1)]
    disc = lambda n, c: d[n][min(c, 3) - 1]
    totals = {n: defaultdict(float) for n in counts}
    held = {n: defaultdict(float) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            totals[n][g[:-1]] += v
            held[n][g[:-1]] += disc(n, v)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        if g[:-1] not in totals[n]:
            return lower
        c = counts[n].get(g, 0)
        own = max(c - disc(n, c), 0) if c else 0
        return (own + held[n][g[:-1]] * lower) / totals[n][g[:-1]]

    return [sum(math.log(p(x[i : i + order])) for x in [kn.normal(t, order)] for i in range(len(x) - order + 1)) if t else 0.0 for t in texts]


@pytest.mark.parametrize("order", [3, 5])
def test_log_probabilities_match_the_definition(spark, order):
    texts = ["the cat sat on the mat", "the dog sat on a log 42", "zz##!! qq", None, "", "a", "the cat sat on the mat", "x" * 3000]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, None), (2, 0, 0), (6, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in kn.perplexities(docs, labels, order).collect()}
    joined = {r.id: r for r in kn.perplexities(docs, labels, order, block_bytes=20).collect()}
    assert all(math.isclose(got[i].log_prob or 0, joined[i].log_prob or 0, abs_tol=1e-9) and got[i].chars == joined[i].chars for i in got)
    train = [texts[i] for i in (0, 1) if not got[i].aside]
    if train:
        for i, want in enumerate(brute(train, texts, order)):
            assert math.isclose(got[i].log_prob or 0, want, rel_tol=1e-9, abs_tol=1e-9)
    out = {r.doc_id: r for r in kn.classify(kn.perplexities(docs, labels, order)).collect()}
    assert len(out) == len(texts) and out[3].kept and out[4].kept and out[3].perplexity is None


def test_rejects_noise_and_keeps_clean(spark):
    import random

    rng = random.Random(3)
    vocabulary = ["time", "house", "river", "green", "walks", "under", "light", "stone", "and", "the"]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(300)]
    noise = ["".join(rng.choice("#@$%^&*QXZ") for _ in range(300)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + noise)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in kn.classify(kn.perplexities(docs, labels)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 330))
    none = kn.classify(kn.perplexities(docs, labels.limit(0)))
    assert none.filter("kept").count() == 330
    assert kn.classify(kn.perplexities(docs.limit(0), labels)).count() == 0


def test_limits_match_brute_force(spark):
    """Limits of each language from its own documents' quantiles, of a small language from all; in bucketed logarithms."""
    import random

    rng, rows = random.Random(12), []
    for i in range(420):
        lang = "en" if i < 200 else "de" if i < 400 else "fi"
        chars = rng.randint(50, 900)
        rows.append((i, lang, i, i % 3 > 0, chars, -chars * (1 + (lang == "de") + rng.random())))
    scored = spark.createDataFrame(rows, "id long, lang string, text_hash long, aside boolean, chars long, log_prob double")
    bucketed = lambda x: (math.floor(x * kn.BUCKETS) + 0.5) / kn.BUCKETS
    at = lambda xs, q: bucketed(sorted(xs)[max(0, math.ceil(q * len(xs) - 1e-9) - 1)])
    own = {k: [r for r in rows if r[3] and k in (r[1], "all")] for k in ("en", "de", "all")}
    mid = {k: at([-r[5] / r[4] for r in v], 0.5) for k, v in own.items()}
    drawn = lambda r: (-r[5] + 100 * mid[r[1] if r[1] in mid else "all"]) / (r[4] + 100)
    limit = {}
    for k, v in own.items():
        q50, q99 = at([drawn(r) for r in v], 0.5), at([drawn(r) for r in v], 0.99)
        limit[k] = q99 + (0.25 + 0.33 / math.sqrt(len(v) / 100)) * (q99 - q50)
    for r in kn.classify(scored).collect():
        own_row = rows[r.doc_id]
        want = limit[own_row[1] if own_row[1] in limit else "all"]
        assert math.isclose(math.log(r.threshold), want, rel_tol=1e-9) and r.kept == (drawn(own_row) <= want)


def test_gram_columns_hold_strings_of_a_slice_only(monkeypatch):
    """Both ways give what whole columns gave, without a Python string for each gram of a block at once."""
    monkeypatch.setattr(kn, "SLICE", 1000)
    rng = np.random.default_rng(3)
    windows = rng.choice(np.array([2, 3, 32, 97, 228, 0x4E2D, 0x1F600], np.uint32), (200_000, 5))
    tracemalloc.start()
    column = kn.gram_column(windows)
    keys = kn.gram_keys(column, 5)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert column.to_pylist() == kn._strings(windows) and column.type == pa.string() and (keys == kn.row_hashes(windows)).all()
    assert most < 12  # a string for each of 200,000 grams takes 15 MB and more
    none = np.zeros((0, 5), np.uint32)
    assert len(kn.gram_column(none)) == 0 == len(kn.gram_keys(kn.gram_column(none), 5))
