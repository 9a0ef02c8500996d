"""Interaction audit of five document filters over all their orders (operator 12).

A document's failures are five bits. A to D are told by the text alone, where it is read. E, a text that a smaller id
has too, is an existential self-join: hashes that two ids share are found without texts, and a left-semi join on hash,
exact text and a smaller doc_id marks them. Its right side is one row a text (its smallest id), so a group of copies
costs its number, not its square. Texts whose hash no other id has are left where they are read, by a bitmap of shared
hashes: 2 ** 24 bits in at most 262,144 rows, so its broadcast is a few MB at any size of the input. It only saves
shuffling: above some millions of shared hashes it lets more texts pass, up to all of them, and the join decides.
Marked ids are united with the rows of the other failures, and a count for each part and combination of bits follows,
which is all that orders need: after filters S, what is kept of a part are the combinations without a bit of S, so 32
sums a part give all 120 orders.

Defined results: null text is empty (so it fails A, and is a copy of other empty texts); null source is the part '',
as is the empty one; a null doc_id is smaller than none and none is smaller than it, and it has no label; rows that
repeat an id are documents each, and no copies of each other; if labels repeat an id, one that says so is enough; an
empty table has no parts and gives no rows. Rows of one id and part are told apart by their text's 64-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import small_batches, stored

FILTERS = "ABCDE"
SYMBOL = re.compile(rb"[#$%&*|]")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITS = 1 << 24  # of the bitmap of shared hashes
COPY = 1 << FILTERS.index("E")
NOT_LOST = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: bytes, n_chars: int) -> int:
    """Bits of A to D; bytes.split parts at the six ASCII spaces and nothing else."""
    words = text.split()
    n = len(words)
    short, repetitive = n < 200, 100 * len(set(words)) < 50 * n
    capitals = 100 * (len(text) - len(text.translate(None, UPPER))) > 2 * n_chars
    return short | repetitive << 1 | capitals << 2 | (SYMBOL.search(text) is not None) << 3


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        text = batch.column("text")
        bits = [text_failures(b, n) for b, n in zip(text.cast(pa.binary()).to_pylist(), pc.utf8_length(text).to_pylist())]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bits, pa.int32())], names=[*keep, "mask"])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h, text): names of our own, so other columns can't clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h"), text.alias("text"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h, mask, n): `n` rows of equal id, part and text with the bits of all filters that they fail."""
    texts = keyed(docs)
    schema = T.StructType([*(f for f in texts.schema.fields if f.name != "text"), T.StructField("mask", T.IntegerType())])
    own = stored(texts.mapInArrow(_mask, schema), "failures")
    shared = own.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h")
    united = own.withColumn("n", F.lit(1).cast("bigint")).unionByName(copies(texts, shared).select("doc_id", "part", "h", F.lit(COPY).alias("mask"), F.lit(0).cast("bigint").alias("n")))
    return united.groupBy("doc_id", "part", "h").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))


def bitmap(hashes: DataFrame) -> DataFrame:
    """(word, bits): at most BITS / 64 rows that hold a bit of each hash."""
    place = F.pmod("h", F.lit(BITS))
    return hashes.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def copies(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of `texts` whose exact text a smaller doc_id has too; `shared`: the hashes that more than one id has."""
    words = stored(bitmap(shared), "bitmap")
    place = F.pmod("h", F.lit(BITS))
    some = texts.filter("doc_id IS NOT NULL").join(F.broadcast(words), F.shiftright(place, 6) == F.col("word")).filter(F.getbit("bits", (place % 64).cast("int")) == 1)
    some = stored(some.drop("word", "bits"), "candidates")  # else the optimizer moves the semi-join below the bitmap
    first = some.groupBy("h", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    a, b = some.alias("a"), stored(first, "first").alias("b")  # stored, so that a large group of copies can be split
    return a.join(b, F.expr("a.h = b.h AND a.text = b.text AND b.first < a.doc_id"), "left_semi")


def combinations(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each combination of failures."""
    judged = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    joined = rows.join(judged, F.col("doc_id") == F.col("_id"), "left")
    lost = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("_good").alias("good"), lost("_toxic").alias("toxic"))


def orders(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts of combinations."""
    whole = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("by"))
    masks = [m for m in range(1 << len(FILTERS))]
    each = lambda c: F.transform(F.array(*map(F.lit, masks)), lambda m: F.coalesce(F.try_element_at("by", m)[c], F.lit(0).cast("bigint")))
    whole = whole.select("part", each("n").alias("n"), each("good").alias("good"), each("toxic").alias("toxic"))
    # left_x[S]: what filters S leave; weighed[f]: of each combination with f, its 120 orders shared among its bits
    left = lambda c: F.expr(f"transform(sequence(0, 31), s -> aggregate(sequence(0, 31), 0L, (a, m) -> a + if((m & s) = 0, {c}[m], 0L)))")
    weighed = F.expr("transform(sequence(0, 4), f -> aggregate(sequence(0, 31), 0L, (a, m) -> a + if((shiftright(m, f) & 1) = 1, n[m] * (120 div bit_count(m)), 0L)))")
    whole = whole.select("part", "n", left("n").alias("left_n"), left("good").alias("left_good"), left("toxic").alias("left_toxic"), weighed.alias("weighed"))
    permuted = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    out = whole.select("*", F.explode(permuted).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    out = out.withColumn("f", F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1)) - 1"))
    out = out.withColumn("before", F.expr(f"aggregate(sequence(1, 5), 0, (a, i) -> a + if(i < step, shiftleft(1, instr('{FILTERS}', substr(filter_order, i, 1)) - 1), 0))"))
    out = out.withColumns({"own": F.expr("shiftleft(1, f)"), "after": F.expr("before | shiftleft(1, f)")})
    gone = lambda c: F.expr(f"{c}[before] - {c}[after]")
    out = out.withColumns({
        "kept": F.expr("left_n[after]"),
        "removed": gone("left_n"),
        "redundant": F.expr("left_n[0] - left_n[own] - (left_n[before] - left_n[after])"),
        "unique_fails": F.expr("n[own]"),
        "good_lost": gone("left_good"),
        "toxic_lost": gone("left_toxic"),
        "shapley": F.expr("weighed[f]"),
    })
    return out.select("part", "filter_order", "step", *NOT_LOST)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(combinations(failures(docs), labels))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
+ 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first < doc_id, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(c, b)),
o AS (SELECT a.c || b.c || p.c || q.c || r.c AS filter_order, [a.b, b.b, p.b, q.b, r.b] AS bits FROM f a, f b, f p, f q, f r WHERE a.b + b.b + p.b + q.b + r.b = 31 AND bit_count(a.b | b.b | p.b | q.b | r.b) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM o, range(1, 6) g(step)),
r AS (SELECT x.part, s.filter_order, s.step, s.own,
coalesce(sum(c.n) FILTER (c.mask & (s.prior | s.own) = 0), 0) AS kept,
coalesce(sum(c.n) FILTER (c.mask & s.prior = 0 AND c.mask & s.own > 0), 0) AS removed,
coalesce(sum(c.n) FILTER (c.mask & s.prior > 0 AND c.mask & s.own > 0), 0) AS redundant,
coalesce(sum(c.n) FILTER (c.mask = s.own), 0) AS unique_fails,
coalesce(sum(c.good) FILTER (c.mask & s.prior = 0 AND c.mask & s.own > 0), 0) AS good_lost,
coalesce(sum(c.toxic) FILTER (c.mask & s.prior = 0 AND c.mask & s.own > 0), 0) AS toxic_lost
FROM (SELECT DISTINCT part FROM c) x CROSS JOIN s JOIN c ON c.part = x.part GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
(sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
