"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text (operator 9).

Grams are `order` consecutive characters (white space runs are one blank, digits are 0, texts are padded at both
ends). Trusted text is all documents labelled of good quality and not toxic; nothing is sampled, so what is counted
grows with the corpus. Steps:

1. Texts are packed into blocks by hash. A block gives its distinct grams, each with its count in trusted text (0 for
   grams of other documents only), and these are summed by gram: the grams to score and the counts in one table.
2. Each lower order follows from the one above as a grouped sum: all suffixes, with their continuation counts (distinct
   left extensions in trusted text). Counts of counts give the discounts D1, D2, D3+ of each order.
3. From the lowest order up, joins sharded by context and by suffix give each gram
   max(c - D(c), 0) / total(context) + gamma(context) * P(suffix), down to the uniform distribution. A gram is joined at
   each order once, however many documents have it, and the model is never gathered or broadcast as a whole.
4. Probabilities go back to the blocks that have the gram, and are summed per document there.
5. One trusted document in `ASIDE` is left out of the counts; the perplexities of these, as unseen as any other
   document's, give each language's quantiles, from counts in logarithmic buckets, which merge by adding. A document
   is kept up to q99 * (q99 / q50) ** m, where m is `margin` and, for the quantile's own error, `doubt` times the
   relative error 1 / sqrt(n / 100) of the n / 100 documents beyond it; short texts are first drawn towards the median
   of their language by `prior` characters. Languages with under `least` such documents take those of all.

There is one path, whatever the sizes. A gram shared by all documents is one row a block, counts are combined before
each shuffle, texts are shuffled in compressed blocks of bounded size, and scratch tables are deleted at the end. Defined results: null or empty text has no perplexity and is kept (nothing speaks against it); without
trusted documents everything is kept; repeated rows count and are judged each; other columns of `docs` are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .util import discard, opened, packed_blocks, release, salt, small_batches, stored

ORDER = 5
BLOCK_BYTES = 32 << 20
PART = 1 << 20
BATCH = 4 << 20
#: Grams that are Python strings at once.
SLICE = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
START, END = "\x02", "\x03"
SPACE, DIGIT = re.compile(r"\s+"), re.compile(r"\d")
BUCKETS = 200
ASIDE = 5


def normal(text: str, order: int = ORDER) -> str:
    return START * (order - 1) + DIGIT.sub("0", SPACE.sub(" ", text)) + END


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of each `order` consecutive code points, of any array with them in its last axis's order."""
    n = len(codes) - order + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        wide = codes.astype(np.uint64)
        wide *= BASE
        wide ^= wide >> np.uint64(31)
        for j in range(order):
            out *= np.uint64(0xD1342543DE82EF95)
            out += wide[j : j + n]
    return out


class Texts:
    """Grams of many texts in one array."""

    def __init__(self, texts: list[str | None], order: int):
        parts = [normal(t, order) if t else "" for t in texts]
        size = np.array([len(p) for p in parts], np.int64)
        self.codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.grams = np.maximum(size - (order - 1), 0)
        end = np.cumsum(size)
        self.hash = gram_hashes(self.codes, order)
        inside = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(inside, (end - size)[self.grams > 0], 1)
        np.add.at(inside, (end - order + 1)[self.grams > 0], -1)
        self.places = np.flatnonzero(np.cumsum(inside)[: len(self.hash)] > 0)
        self.owner = np.repeat(np.arange(len(texts)), self.grams)


def _windows(own: Texts, at: np.ndarray, order: int) -> np.ndarray:
    """The code points of the grams at `at` of the text's places, a row each."""
    return own.codes[own.places[at][:, None] + np.arange(order)]


def _strings(windows: np.ndarray) -> list[str]:
    order = windows.shape[1]
    flat = windows.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + order] for i in range(0, len(flat), order)]


def gram_column(windows: np.ndarray) -> pa.ChunkedArray:
    """The grams of `windows`, with Python strings of a slice at a time."""
    return pa.chunked_array([pa.array(_strings(windows[i : i + SLICE]), pa.string()) for i in range(0, len(windows), SLICE)], pa.string())


def gram_keys(grams: pa.ChunkedArray, order: int) -> np.ndarray:
    """`row_hashes` of a column of grams, with Python strings of a slice at a time."""
    out = np.empty(len(grams), np.uint64)
    for i in range(0, len(grams), SLICE):
        part = "".join(grams.slice(i, SLICE).to_pylist()).encode("utf-32-le", "surrogatepass")
        out[i : i + SLICE] = row_hashes(np.frombuffer(part, np.uint32).reshape(-1, order))
    return out


def block_number(n: int) -> Column:
    return salt([F.col("id"), F.col("text_hash")], n)


def blocks_of(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, blob) of `rows` (id, text, ...) and the number of blocks."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return rows.withColumn("_block", block_number(n)).mapInArrow(packed_blocks, "block int, blob binary"), n


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the place of one of each, and the number of each hash's distinct one; by a hash table, unsorted."""
    which, found = pd.factorize(hashes)
    at = np.empty(len(found), np.int64)
    at[which] = np.arange(len(hashes))
    return found, at, which


class Counted:
    """Distinct grams with their counts in trusted text; parts are merged when they hold as many as those merged before."""

    def __init__(self, order: int):
        self.order, self.parts = order, [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, order), np.uint32))]

    def add(self, texts: list[str | None], trusted: np.ndarray) -> None:
        own = Texts(texts, self.order)
        if len(own.places):
            hashes, at, which = _distinct(own.hash[own.places])
            n = np.bincount(which, trusted[own.owner], len(hashes)).astype(np.int64)
            self.parts.append((hashes, n, _windows(own, at, self.order)))
            if sum(len(h) for h, _, _ in self.parts[1:]) > max(1 << 20, len(self.parts[0][0])):
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts and code points of the grams so far."""
        hashes, n, windows = (np.concatenate(c) for c in zip(*self.parts))
        found, at, which = _distinct(hashes)
        self.parts = [(found, np.bincount(which, n, len(found)).astype(np.int64), windows[at])]
        return self.parts[0][1:]


def block_grams(blocks: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, gram, c): each block's distinct grams and their counts in the documents of `trusted` (block, id)."""

    def run(blobs: pa.Table, ids: pa.Table) -> pa.Table:
        release()
        held, good = Counted(order), ids.column("id").combine_chunks()
        for batch in opened(blobs.column("blob")):
            for part in small_batches([batch], PART):
                mine = pc.is_in(part.column("id"), value_set=good).to_numpy(zero_copy_only=False)
                held.add(part.column("text").to_pylist(), mine)
        n, windows = held.merge()
        block = np.full(len(n), blobs.column("block")[0].as_py() if blobs.num_rows else 0, np.int32)
        return pa.table([pa.array(block), gram_column(windows), pa.array(n)], ["block", "gram", "c"])

    return blocks.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(run, "block int, gram string, c bigint")


def lower_order(table: DataFrame, n: int) -> DataFrame:
    """(gram, c) of order `n` from that above it: all suffixes, and their numbers of distinct left extensions seen."""
    return table.groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count_if(F.col("c") > 0).alias("c"))


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from counts of counts; each within [0, its count]."""
    n1, n2, n3, n4 = (x or 0 for x in table.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))


def _discount(c, d):
    return F.when(c >= 3, d[2]).when(c == 2, d[1]).when(c == 1, d[0]).otherwise(0.0)


def probabilities(tables: list[DataFrame]) -> DataFrame:
    """(gram, logp) of the highest order of `tables` (gram, c; of order 1 and up), whose c is 0 for grams not seen."""
    ds = [discounts(t) for t in tables]
    c = F.col("c")
    first = tables[0].agg(F.count_if(c > 0).alias("v"), F.sum("c").alias("total"), F.sum(_discount(c, ds[0])).alias("held")).first()
    # one character more stands for all never seen
    out = tables[0].select("gram", ((c - _discount(c, ds[0]) + first["held"] / (first["v"] + 1)) / first["total"]).alias("p"))
    for n, (t, d) in enumerate(zip(tables[1:], ds[1:]), 2):
        seen = t.filter("c > 0").groupBy(F.substring("gram", 1, n - 1).alias("context"))
        context = seen.agg(F.sum("c").alias("total"), F.sum(_discount(c, d)).alias("held"))
        lower = out.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        met = t.join(lower, F.substring("gram", 2, n - 1) == F.col("suffix")).join(context, F.substring("gram", 1, n - 1) == F.col("context"), "left")
        p = (c - _discount(c, d) + F.col("held") * F.col("lower")) / F.col("total")
        out = met.select("gram", F.coalesce(p, "lower").alias("p"))
    return out.select("gram", F.log("p").alias("logp"))


def row_hashes(codes: np.ndarray) -> np.ndarray:
    """`gram_hashes` of each row of a matrix of code points."""
    out = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        wide = codes[:, j].astype(np.uint64) * BASE
        wide ^= wide >> np.uint64(31)
        out = out * np.uint64(0xD1342543DE82EF95) + wide
    return out


def block_sums(blocks: DataFrame, known: DataFrame, kinds: StructType, order: int = ORDER) -> DataFrame:
    """(id, lang, text_hash, chars, log_prob) of every row of `blocks`, from each block's `known` (block, gram, logp)."""
    schema = StructType([*(kinds[c] for c in ("id", "lang", "text_hash")), StructField("chars", LongType()), StructField("log_prob", DoubleType())])
    empty = to_arrow_schema(schema).empty_table()

    def run(blobs: pa.Table, known: pa.Table) -> pa.Table:
        release()
        keys, values = pd.Index(gram_keys(known.column("gram"), order)), known.column("logp").to_numpy()
        out = []
        for batch in opened(blobs.column("blob")):
            for part in small_batches([batch], PART):
                own = Texts(part.column("text").to_pylist(), order)
                each = values[keys.get_indexer(own.hash[own.places])]
                total = np.bincount(own.owner, each, len(own.grams)) if len(each) else np.zeros(len(own.grams))
                out.append(pa.table([part.column("id"), part.column("lang"), part.column("text_hash"), pa.array(own.grams), pa.array(total)], empty.schema.names))
        return pa.concat_tables(out) if out else empty

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def perplexities(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, lang, text_hash, aside, chars, log_prob) of every row; log_prob is null without a model."""
    text, lang = F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    rows = docs.select(F.col(id_col).alias("id"), text, lang, F.xxhash64(text_col).alias("text_hash"))
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").alias("id")).filter("id is not null").distinct()
    good = stored(good.withColumn("aside", F.pmod(F.xxhash64(F.col("id"), F.lit("aside")), F.lit(ASIDE)) == 0), "trusted")
    blocks, n = blocks_of(rows, block_bytes)
    # ids only are joined, so no text is shuffled for its label
    trusted = rows.select("id", block_number(n).alias("block")).join(good.filter("not aside").select("id"), "id", "left_semi").select("block", "id").distinct()
    pairs = stored(block_grams(blocks, trusted, order), "grams", drop_shuffles=True, batch_bytes=BATCH)
    scratch, tables = [good, pairs], [stored(pairs.groupBy("gram").agg(F.sum("c").alias("c")), f"order{order}", drop_shuffles=True)]
    if tables[0].filter("c > 0").isEmpty():
        chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars")
        sums = rows.select("id", "lang", "text_hash", chars, F.lit(None).cast("double").alias("log_prob"))
    else:
        for k in range(order - 1, 0, -1):
            tables.insert(0, stored(lower_order(tables[0], k), f"order{k}", drop_shuffles=True))
        scored = stored(probabilities(tables), "scored", drop_shuffles=True)
        scratch.append(scored)
        sums = block_sums(blocks, pairs.join(scored, "gram").select("block", "gram", "logp"), rows.schema, order)
    out = stored(sums.join(good.filter("aside"), "id", "left").withColumn("aside", F.coalesce("aside", F.lit(False))), "sums", drop_shuffles=True, batch_bytes=BATCH)
    discard(*scratch, *tables)
    return out


def quantiles(rows: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """Quantiles of log perplexity by `keys`, from counts in buckets of 1 / BUCKETS."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = rows.groupBy(*keys, F.floor(F.col("log_ppl") * BUCKETS).alias("b")).agg(F.count("*").alias("n"))
    counts = counts.withColumns({"upto": F.sum("n").over(w.orderBy("b")), "all": F.sum("n").over(w)})
    return counts.groupBy(*keys).agg(F.max("all").alias("all"), *(F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("b") + 0.5) / BUCKETS)).alias(name) for name, q in qs.items()))


def classify(scored: DataFrame, margin: float = 0.25, doubt: float = 0.33, prior: int = 100, least: int = 50, id_col: str = "doc_id") -> DataFrame:
    """(id, lang, text_hash, chars, perplexity, threshold, kept) from `perplexities`."""
    scored = scored.withColumn("log_ppl", -F.col("log_prob") / F.when(F.col("chars") > 0, F.col("chars")))
    trusted = scored.filter("aside and log_ppl is not null").select("lang", "log_ppl", "chars")
    every = quantiles(trusted, [], {"mid": 0.5})
    by_lang = quantiles(trusted, ["lang"], {"mid": 0.5})
    langs = scored.select("lang").distinct().crossJoin(F.broadcast(every.select(F.col("mid").alias("mid0"))))  # one row
    middle = langs.join(by_lang, langs["lang"].eqNullSafe(by_lang["lang"]), "left").select(langs["lang"].alias("l"), F.when(F.col("all") >= least, F.col("mid")).otherwise(F.col("mid0")).alias("mid"))
    drawn = scored.join(middle, scored["lang"].eqNullSafe(middle["l"]), "left").withColumn("drawn", (-F.col("log_prob") + prior * F.col("mid")) / (F.col("chars") + prior)).drop("l")
    seen = drawn.filter("aside and log_ppl is not null").select("lang", F.col("drawn").alias("log_ppl"))
    qs = {"q50": 0.5, "q99": 0.99}
    wide = F.col("q99") + (margin + doubt / F.sqrt(F.col("all") * 0.01)) * (F.col("q99") - F.col("q50"))
    all_q = quantiles(seen, [], qs).select(wide.alias("limit0"))
    lang_q = quantiles(seen, ["lang"], qs)
    limits = scored.select("lang").distinct().crossJoin(F.broadcast(all_q))
    limits = limits.join(lang_q, limits["lang"].eqNullSafe(lang_q["lang"]), "left").select(limits["lang"].alias("l"), F.when(F.col("all") >= least, wide).otherwise(F.col("limit0")).alias("limit"))
    out = drawn.join(limits, drawn["lang"].eqNullSafe(limits["l"]), "left")
    return out.select(F.col("id").alias(id_col), "lang", "text_hash", "chars", F.exp("log_ppl").alias("perplexity"), F.exp("limit").alias("threshold"), F.coalesce(F.col("drawn") <= F.col("limit"), F.lit(True)).alias("kept"))
