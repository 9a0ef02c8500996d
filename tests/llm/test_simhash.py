import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from statloom.llm import simhash


def brute_fingerprint(text, width=4):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" "):
        if w:
            words.append(w)
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs, max_bits):
    parent = {f: f for _, f in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= max_bits:
            parent[root(a)] = root(b)
    least = {}
    for i, f in pairs:
        least[root(f)] = min(least.get(root(f), i), i)
    return {i: least[root(f)] for i, f in pairs}


def test_fingerprint_matches_brute_force():
    for t in [None, "", " \n", "One", "a b c", "A b\tc d", "É b c d e", "x y z w " * 40, "the end of the end of the end"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def steps(v):
    return sum(sum(v >> 2 * i + j & 1 for j in (0, 1)) << 2 * i for i in range(32))


@pytest.mark.parametrize("n", [1, 300, 1 << 22, 1 << 33])
@pytest.mark.parametrize("max_bits", [0, 3, 4, 7])
def test_masks_leave_no_pair_out(n, max_bits):
    rng, ms = random.Random(1), simhash.masks(n, max_bits)
    for i in range(400):
        x = rng.getrandbits(64)
        flipped = rng.sample(range(64), max_bits) if i % 2 else range(b := rng.randint(0, 64 - max_bits), b + max_bits)
        y = x ^ sum(1 << b for b in flipped)
        assert any((steps(x) ^ steps(y)) & a == 0 and (steps(x >> 1) ^ steps(y >> 1)) & b == 0 for a, b in ms)


@pytest.mark.parametrize("n,choices", [(1 << 20, 15), (10**8, 35), (2 * 10**9, 70), (3 * 10**10, 126)])
def test_mates_of_random_values_stay_few(n, choices):
    """Of any size, a pair of masks tells random values apart to at most eight mates (expected, from the masks' bits)."""
    ms = simhash.masks(n, 4)
    assert len(ms) == choices
    for a, b in ms:
        bits, chance = a, 1.0
        while bits:  # a run of w bits: all values but 01..01 and 10..10 have steps of their own
            low = (bits & -bits).bit_length() - 1
            w = ((bits >> low) + 1 & -((bits >> low) + 1)).bit_length() - 1
            bits &= ~(((1 << w) - 1) << low)
            chance *= 2.0**-w
        assert n * chance <= 8 and (a & b) == b


def test_steps_are_the_table_of_distances(spark):
    rng = random.Random(4)
    values = [0, 2**64 - 1, *(rng.getrandbits(64) for _ in range(50))]
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = df.select("fp", simhash.pivot_steps(F.col("fp")).alias("s"), simhash.pivot_steps(F.shiftrightunsigned("fp", 1)).alias("s2"))
    for r in got.collect():
        for pivots, s in ((simhash.PIVOTS, r.s), (simhash.SHIFTED, r.s2)):
            d = [((r.fp % 2**64) ^ p).bit_count() for p in pivots]
            assert [(s % 2**64) >> 2 * i & 3 for i in range(len(d) - 1)] == [(2 - (b - a)) // 2 for a, b in zip(d, d[1:])]


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    values = []
    for _ in range(60):
        f = rng.getrandbits(64)
        values.append(f)
        for _ in range(rng.choice([0, 0, 1, 8])):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            values.append(f)
    center = rng.getrandbits(64)  # a dense group, whose members mostly lie over 4 bits apart
    values += [center ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(200)]
    pairs = list(enumerate(dict.fromkeys(values)))
    df = spark.createDataFrame([(simhash._signed(f),) for _, f in pairs], "fp long")
    got = {r.fp: r.component for r in simhash.near_components(df).collect()}
    want = brute_components(pairs, 4)
    groups = {}
    for i, f in pairs:
        groups.setdefault(want[i], set()).add(simhash._signed(f))
    for members in groups.values():
        labels = {got.get(f, f) for f in members}
        assert labels == {min(members)}


def test_near_duplicates_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(7, text, "a"), (3, text, "b"), (9, text.replace("w299", "zz"), "c"), (1, None, "d"), (2, "", "e"), (2, "", "e"), (4, "solo", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(i, brute_components([(j, brute_fingerprint(t)) for j, t, _ in rows], 4)[i]) for i, _, _ in rows}
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
