"""A worker process is used for many stages: what one leaves must not add to the memory of the next."""

import pyarrow as pa

from statloom.llm import packing, util


def test_one_model_a_worker():
    made = []
    make = lambda name: lambda: made.append(name) or [name]
    first = util.worker_model("a", make("a"))
    assert util.worker_model("a", make("a")) is first and made == ["a"]
    util.worker_model("b", make("b"))
    assert list(util._HELD) == ["b"]
    util.release()
    assert not util._HELD


def test_packing_and_counting_share_the_place_of_the_model():
    """The packing's tokenizer goes when another operator's model or a block comes, and the other way round."""
    util.worker_model("chunks", lambda: object())
    list(util.packed_blocks(iter([pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array(["x"])], ["_block", "text"])])))
    assert not util._HELD


def anonymous_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024


def test_free_memory_goes_back():
    util.release()
    before = anonymous_mb()
    held = [pa.array(range(1_000_000)) for _ in range(20)]
    del held
    util.release()
    assert anonymous_mb() - before < 60


def test_packing_reads_small_batches(spark, monkeypatch):
    """Executor and worker hold an Arrow batch each while texts are tokenized: packing's are bounded by bytes, not by 10,000 rows."""
    asked = []
    real = util.stored
    monkeypatch.setattr(packing, "stored", lambda df, name, **how: asked.append(how["batch_bytes"]) or real(df, name, **how))
    docs = spark.range(2_000, numPartitions=1).selectExpr("id AS doc_id", "repeat('a ', 1000) AS text")
    size = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    most = lambda **how: real(docs.mapInArrow(size, "n long"), "sizes", **how).agg({"n": "max"}).first()[0]
    assert most() > 3_000_000 > 600_000 > most(batch_bytes=500_000)
    assert spark.conf.get(util.BATCH_BYTES, None) is None
    cut = spark.createDataFrame([(1, 0, 0, 5, 1)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.pack(cut).count() == 1 and asked == [packing.BATCH]


def test_bounded_batches_read_texts_few_rows_at_a_time(spark, tmp_path):
    """Spark's reader holds the whole texts of its batch: 4,096 rows of any length by default."""
    spark.range(3_000, numPartitions=1).selectExpr("id", "repeat('a', 50) AS text").write.parquet(str(tmp_path / "docs"))
    asked = []
    real = type(spark.conf).set

    def noted(self, key, value):
        asked.append((key, value))
        real(self, key, value)

    type(spark.conf).set = noted
    try:
        out = util.stored(spark.read.parquet(str(tmp_path / "docs")), "few", batch_bytes=1 << 20)
    finally:
        type(spark.conf).set = real
    assert out.count() == 3_000 and (util.READ_ROWS, "512") in asked
    assert spark.conf.get(util.READ_ROWS) == "4096"


def test_packing_keeps_as_many_parts_as_it_is_told(spark, monkeypatch):
    """The pipeline packs with a smaller memo than op3, and to the same pieces."""
    import corpus_pipeline
    import public_tokenizers

    vocabulary, asked = packing_vocabulary(public_tokenizers), []
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j % 7} Größe{j}" for j in range(40))) for i in range(30)], "doc_id long, text string")
    rows = lambda **how: sorted(map(tuple, packing.pieces(docs, vocabulary, **how).collect()))
    assert rows(memo=3) == rows()
    own = packing.ChunkTokenizer(vocabulary, 3)
    own.ids(pa.array(["a b c d e f g h i j k"]))
    assert len(own.memo.young) <= 3 and len(own.memo.old) <= 3
    real = packing.pieces
    monkeypatch.setattr(packing, "pieces", lambda *a, **how: asked.append(how["memo"]) or real(*a, **how))
    assert corpus_pipeline.best_fit_packing(spark, docs, "").count() == 30 and asked == [corpus_pipeline.MEMO] and asked[0] < packing.MEMO


def packing_vocabulary(tokenizers) -> bytes:
    with open(tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()
