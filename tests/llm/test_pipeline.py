import random

import corpus_pipeline


def test_stages_end_to_end(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("ba", "re", "ti", "mo", "lu", "sa") for b in ("ner", "ling", "to", "ver", "mi", "den")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(80)
    rows = [(i, text(rng.randint(60, 200)), "en", f"s{i % 3}") for i in range(200)]
    rows += [(500, rows[3][1], "en", "s0"), (501, rows[4][1] + " " + passage, "en", "s0"), (502, text(90) + " " + passage, "en", "s1"), (503, "#$%& " * 100, "en", "s2"), (504, None, "en", None), (505, "", None, "s1"), (506, text(3000), "en", "s1")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert passage in texts[501] and passage not in texts[502]
    classified, ruled, near, _, packed = kept
    assert set(range(200)) <= classified and 503 not in classified
    assert set(range(200)) <= ruled and not {504, 505} & ruled
    assert 3 in near and 500 not in near and {501, 502, 506} <= near
    assert packed == near


def run_stages(spark, docs, labels, folder):
    labels.write.parquet(f"{folder}/labels.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_odd_tables(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("ba", "re", "ti", "mo", "lu", "sa") for b in ("ner", "ling", "to", "ver", "mi", "den")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    a, b, c = text(80), text(90), text(100)
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, text(70)), (3, a), (4, None)] + [(10 + i, text(80)) for i in range(200)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, fp string"
    docs = spark.createDataFrame([(i, t, None, None, None, "w", "k", "f") for i, t in rows], schema)
    labels = spark.createDataFrame([(10 + i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    (tmp_path / "some").mkdir()
    (tmp_path / "none").mkdir()
    stages = run_stages(spark, docs, labels, tmp_path / "some")
    near = sorted(((r.doc_id, r.text) for r in stages[2].collect()), key=str)
    # (1, b) heads (2, b): both stay apart from (1, a), which heads (3, a) and its own copy
    assert near == sorted([(1, a), (1, b), *((i, t) for i, t in rows if i is None or i >= 10)], key=str)
    assert all(d.columns == docs.columns for d in stages[:4]) and {(r.n_words, r.kept, r.fp) for r in stages[3].collect()} == {("w", "k", "f")}
    assert [d.count() for d in run_stages(spark, docs.limit(0), labels.limit(0), tmp_path / "none")] == [0] * 5
