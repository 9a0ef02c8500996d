import random
import re
from collections import Counter

from statloom.llm import quality_rules as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORDS.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts_match_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a a", "x#y *z|\nx#y *z|\n\nq", "é b\x0bc\x1cd " * 30, "w " * 20_000]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 80))).replace("a b", "a\nb") for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in q.features(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(t), t


def test_bucket_keeps_six_bits(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 10**7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in df.select(q.bucket(df.v)).collect()] == [v if v < 64 else v >> (v.bit_length() - 6) << (v.bit_length() - 6) for v in values]


def test_thresholds_adapt_and_odd_rows(spark):
    rng = random.Random(2)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    rows = [(i, plain(), "en", "hot") for i in range(200)] + [(1000 + i, plain().replace(" ", " # "), "en", "code") for i in range(80)]
    rows += [(2000, plain().replace(" ", "### "), "en", "hot"), (2001, None, None, None), (2002, plain(), None, None), (2002, plain(), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnRenamed("zz", "zz")
    f = q.features(docs.selectExpr("*", "'old' AS kept", "7 AS n_words"))
    got = q.judged(f, q.thresholds(q.sketches(f))).collect()
    by = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows)
    assert all(by[i] for i in range(200)) and all(by[1000 + i] for i in range(80))  # many symbols are usual in that source
    assert not by[2000] and not by[2001] and by[2002]
    empty = q.features(docs.limit(0))
    assert q.judged(empty, q.thresholds(q.sketches(empty))).count() == 0


def test_null_and_empty_names_are_groups_of_their_own(spark):
    rng = random.Random(2)
    plain = lambda mark: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + mark for _ in range(80))
    rows = [(i, plain(""), None, None) for i in range(60)] + [(100 + i, plain("#"), "", "") for i in range(60)] + [(200, plain("#"), None, None)]
    f = q.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    limits = q.thresholds(q.sketches(f))
    assert limits.count() == 2
    kept = {r.doc_id for r in q.judged(f, limits).filter("kept").collect()}
    assert kept == {*range(60), *range(100, 160)}
