from statloom.llm import kneser_ney


def test_texts_a_little_beyond_the_trusted_are_rejected(spark):
    n = 100_000
    rows = [(i, "en", i, True, n, -n * (1 + i / 100)) for i in range(101)] + [(1000, "en", 1000, False, n, -n * 2.3), (1001, "en", 1001, False, n, -n * 1.9)]
    scored = spark.createDataFrame(rows, "id long, lang string, text_hash long, aside boolean, chars long, log_prob double")
    kept = {r.doc_id: r.kept for r in kneser_ney.classify(scored).collect()}
    assert not kept[1000] and kept[1001]
    assert {r.doc_id: r.kept for r in kneser_ney.classify(scored, margin=1.0).collect()}[1000]  # the former margin
