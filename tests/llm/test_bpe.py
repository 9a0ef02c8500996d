import hashlib

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from statloom.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = bpe.read_vocabulary(PATH)
MODEL = bpe.BytePairModel(DATA, memo=50)
OWN = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0'stredvml0²é漢😀<|>#"), st.characters(codec="utf-8")), max_size=60))
def test_same_as_the_library(text):
    want = OWN.encode(text, add_special_tokens=False).ids
    texts = pa.array([text, "", text])
    ids = MODEL.encode_column(texts)
    assert ids.to_pylist() == [want, [], want]
    assert MODEL.count_column(texts).tolist() == [len(want), 0, len(want)]
    assert str(list(MODEL.decoded(ids))[2], "utf-8") == OWN.decode(want, skip_special_tokens=False)
    n, names, decoded = MODEL.digest_column(texts)
    assert (n[2].as_py(), names[2], decoded[2]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert names[1] == decoded[1] == hashlib.sha256(b"").hexdigest()


def test_bytes_that_are_no_utf8():
    ids = pa.array([[OWN.encode("é").ids[0]] if len(OWN.encode("é").ids) > 1 else [OWN.token_to_id("Ã")]], pa.list_(pa.int32()))
    assert str(next(MODEL.decoded(ids)), "utf-8") == OWN.decode(ids[0].as_py(), skip_special_tokens=False) == "\ufffd"


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 20_000, "ab " * 5000, "\n\n a\n", "don't  stop"])
def test_special_and_long_texts(text):
    want = OWN.encode(text, add_special_tokens=False).ids
    assert MODEL.encode_column(pa.array([text])).to_pylist() == [want] and MODEL.count_column(pa.array([text])).tolist() == [len(want)]


def test_tables(spark):
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", 7), (3, "", 7), (4, "é" * 3000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_table(docs, DATA).collect()
    assert all(list(r.ids) == OWN.encode(t or "", add_special_tokens=False).ids and r.decoded == (t or "") for r, (_, t, _) in zip(sorted(got, key=lambda r: r.doc_id), rows))
    counts = sorted(map(tuple, bpe.token_counts(docs, DATA, 100).collect()))
    assert counts == [(1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False), (3, 0, 0, False), (4, 6000, len(OWN.encode("é" * 3000).ids), True)]
    assert sorted(r.doc_id for r in bpe.encode_digests(docs, DATA).collect()) == [1, 2, 3, 3, 4]
    assert bpe.token_counts(docs.limit(0), DATA).count() == bpe.encode_digests(docs.limit(0), DATA).count() == 0
