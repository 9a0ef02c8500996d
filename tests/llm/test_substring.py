import random

import numpy as np

from statloom.llm import substring


def brute(rows, window):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            place = (2**63 - 1 if i is None else i, s)
            first[k] = min(first.get(k, place), place)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] != (2**63 - 1 if i is None else i, s):
                gone.update(range(s, s + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def check(spark, rows, window=20, block_bytes=4000):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    got = substring.remove_repeats(docs.repartition(3), window, block_bytes=block_bytes)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=str) == brute(rows, window)


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}é" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 90))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "\n", "\t "]).join(words)))
    copy = [rng.choice(vocabulary) for _ in range(700)]
    rows += [(2_000_000 + k, " ".join(copy)) for k in range(15)]
    rows += [(3_000_000 + k, " ".join([*copy[:300], f"edit{k}", *copy[301:]])) for k in range(15)]
    check(spark, rows)


def test_odd_rows(spark):
    loop = "a b " * 60
    rows = [(1, None), (2, ""), (3, loop), (4, loop), (4, loop), (None, loop), (5, "one two three"), (6, "x " * 19), (7, "y " * 20), (8, "y " * 21), (9, "z\x1c \x0b" * 40)]
    check(spark, rows)
    check(spark, rows, window=3, block_bytes=10)
    check(spark, rows[:2])


def test_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hits_are_the_automaton_s(spark):
    rng = random.Random(2)
    words = [f"v{rng.randrange(60)}" for _ in range(3000)]
    for window in (20, 7, 3):
        flat = substring.Flat([" ".join(words[:2000]), None, " ".join(words[1500:])], [1, 2, 3], window)
        key, mixed, least = flat.anchors()
        places = flat.anchor_places(mixed, least)
        confirmed = set(rng.sample(sorted(set(key[places].tolist())), 20))
        own = [min(range(s, s + window - flat.phrase + 1), key=lambda p: mixed[p]) for s in flat.starts.tolist()]
        automaton = substring.compiled(np.array(sorted(confirmed), np.uint64), flat.phrase)
        assert flat.hits(automaton).tolist() == [int(key[p]) in confirmed for p in own]
        assert not flat.hits(substring.compiled(np.zeros(1, np.uint64) + 7, flat.phrase)).any()
    assert substring.compiled(np.zeros(0, np.uint64), 10) is None  # nothing confirmed: nothing is streamed, nothing removed
