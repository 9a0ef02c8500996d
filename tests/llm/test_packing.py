import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from statloom.llm import bpe, packing  # noqa: E402


def fewest(lengths, capacity):
    """Brute force over all assignments, by fewest bins."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, (*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]))
        go(i + 1, (*bins, lengths[i]))

    go(0, ())
    return best


def test_plan_packs_every_item_and_is_optimal_on_small_cases():
    random.seed(3)
    for _ in range(120):
        capacity = random.choice([10, 17, 30])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        counts = defaultdict(int)
        for x in lengths:
            counts[x] += 1
        chosen = packing.plan(dict(counts), capacity)
        packed = defaultdict(int)
        for filling, times in chosen:
            assert sum(x * n for x, n in filling.items()) <= capacity
            for x, n in filling.items():
                packed[x] += n * times
        assert packed == counts
        assert sum(n for _, n in chosen) == fewest(sorted(lengths, reverse=True), capacity)


def test_completion_beats_best_fit_decreasing():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # total 40 = 4 bins of 10; best fit may need more elsewhere
    assert sum(n for _, n in packing.plan(counts, 10)) == packing.lower_bound(counts, 10) == 4


def test_pack_matches_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = [(1, "Hello  World's\x1ctest <|endoftext|>", "x"), (2, None, "y"), (3, "", None), (4, "nã É ½ 12" * 900, "z"), (5, "a b c", "q"), (5, "a b c", "q"), (None, "word", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(packing.pieces(docs, bpe.read_vocabulary(path), 64), 64).collect()
    want = defaultdict(int)
    for i, t, _ in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 64)):
            want[i, p, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own_rows in bins.values():
        at = 0
        for offset, length in sorted(own_rows):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(docs.limit(0), bpe.read_vocabulary(path), 64), 64).count() == 0


def test_chunks_give_the_library_s_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, mine = Tokenizer.from_file(path), packing.ChunkTokenizer(bpe.read_vocabulary(path), memo=40)
    rng = random.Random(9)
    alphabet = "\x7f\x00aZéÉßµªº²½÷×0 \n\t\x1c\x85\xa0́'stre<|>#*_.İ漢😀ǅ　"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(8000)] + ["it's I'LL don't", "<|endoftext|>a<|startoftext|>", "THE***the,The"]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, ids in zip(part, mine.ids(pa.array(part)).to_pylist(), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_fillings_of_many_lengths_spread_by_waste():
    counts = dict.fromkeys(range(20, 261), 2)
    got = packing.fillings(counts, 1000)
    assert {sum(x * n for x, n in own.items()) for own in got} == {1000}
    assert len({max(x for x, n in own.items() if x < 260) if own[260] == 1 else 260 for own in got}) > 1
    assert len({tuple(sorted(own.items())) for own in got}) == len(got) == 12


def test_plan_reaches_the_bound_where_a_narrow_search_does_not():
    rng, counts = random.Random(13), defaultdict(int)
    for _ in range(60):
        counts[rng.randrange(20, 90)] += rng.choice([1, 1, 2, 5])
    assert sum(n for _, n in packing.plan(dict(counts), 200)) == packing.lower_bound(counts, 200) == 35
