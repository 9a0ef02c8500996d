"""SimHash near-duplicates by pivot distance tables (operator 5).

Fingerprints are computed per document, map only, and reduced to distinct values with their smallest document. The
reference fingerprints are two staircases (`PIVOTS`, `SHIFTED`; 33 and 32): each pivot has two more bits set than the
one before, so a value's distances to neighbours differ by -2, 0 or 2, and a row of distances is kept as steps of two
bits. The second staircase's steps straddle those of the first. The bits fall into `max_bits` + k groups; two values
within `max_bits` of each other agree in k of them at least, and so in the steps of both staircases that lie inside
these groups: pairs meet under the steps of each choice of k groups, and candidates come from the pivot tables alone.
Steps that straddle tell nearly all bits of a group (all but 01..01 from 10..10), so k groups tell about
64 k / (max_bits + k) bits; k grows until that is the logarithm of the number of values, so that random values have
eight mates a choice at most at every size (groups differ by two bits, so a choice may have three bits less). The rows a value are the choices: 15 up to a million values, 35 to 10^8,
70 to 2 x 10^9, 126 to 3 x 10^10. A pair is discarded when a distance to one of `TESTED` pivots differs by over
`max_bits` (the triangle inequality), and survivors are verified.

A group of thousands of near copies would meet as all pairs. So each bucket is first linked to its smallest and
largest member only, linear work; components of those links are found, and then only members of different
components meet: those outside a bucket's most frequent component against all of the bucket. No link between
components is lost, and links within one would change nothing.

Defined results: null text has no words, fingerprint zero, and links like any other; repeated rows share a
fingerprint and a component; a null id never names a component unless it stands alone; an empty table gives an
empty result; other columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import small_batches, stored

SEED = 42
STEPS = 32
#: Reference fingerprints: their lowest 0, 2, 4, ... 64 bits are set.
PIVOTS = [(1 << 2 * i) - 1 for i in range(STEPS + 1)]
#: The same without bit 0 and one bit further.
SHIFTED = [p << 1 for p in PIVOTS[:STEPS]]
#: Pivots whose distances are compared pair by pair.
TESTED = PIVOTS[::4][:8]


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n < width:
        return digest(flat, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[width - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp bigint) and the columns `keep`: the 64 bits as a signed number; map only."""

    def run(batches):
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], [id_col, "fp", *keep])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp bigint" + (kinds and f", {kinds}"))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivot_steps(fp: Column) -> Column:
    """The row of distances to all pivots, as 32 steps: (2 - (d(fp, pivot i + 1) - d(fp, pivot i))) / 2, two bits each.

    That is the number of bits which the fingerprint has among those that the pivots differ in, for all steps at once."""
    lowest = F.lit(int("01" * STEPS, 2))
    low, high = fp.bitwiseAND(lowest), F.shiftrightunsigned(fp, 1).bitwiseAND(lowest)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def pivot_table(fp: Column) -> Column:
    """Distances to the tested pivots, eight bits each, as one number."""
    out = F.lit(0).cast("bigint")
    for i, p in enumerate(TESTED):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("bigint"), 8 * i))
    return out


def near(fp_a: Column, table_a: Column, fp_b: Column, table_b: Column, max_bits: int) -> Column:
    """No coordinate differs by more than `max_bits`, and the fingerprints don't either."""
    out = None
    for i in range(len(TESTED)):
        d = F.abs(F.shiftrightunsigned(table_a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(table_b, 8 * i).bitwiseAND(F.lit(255))) <= max_bits
        out = d if out is None else out & d
    return out & (F.bit_count(fp_a.bitwiseXOR(fp_b)) <= max_bits)


def masks(n: int, max_bits: int) -> list[tuple[int, int]]:
    """Masks of both staircases' steps such that values within `max_bits` agree under one pair of them.

    There are max_bits + k groups of bits, and a pair of masks for any k of them; k grows with the number of values."""
    k = 1
    while k < STEPS - max_bits and 2 * STEPS * k // (max_bits + k) < max(1, n).bit_length():
        k += 1
    cuts = [2 * (STEPS * i // (max_bits + k)) for i in range(max_bits + k + 1)]
    # the second staircase's step at a place is of the two bits after it, so a group's last one would leave the group
    groups = [((1 << b) - (1 << a), (1 << max(a, b - 2)) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [(sum(g for g, _ in c), sum(g for _, g in c)) for c in combinations(groups, k)]


def meeting_key(first: Column, second: Column, mask: tuple[int, int]) -> Column:
    """One number of the steps under a pair of masks; other steps may share it, and verification tells them apart."""
    return F.xxhash64(first.bitwiseAND(F.lit(_signed(mask[0]))), second.bitwiseAND(F.lit(_signed(mask[1]))))


def near_components(values: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, component) of distinct `values` (fp): component is the smallest fp reachable; values without a link are left out."""
    n = values.count()
    keys = F.array(*(F.struct(F.lit(i).cast("smallint").alias("m"), meeting_key(F.col("s"), F.col("s2"), m).alias("bits")) for i, m in enumerate(masks(n, max_bits))))
    table = values.withColumns({"s": pivot_steps(F.col("fp")), "s2": pivot_steps(F.shiftrightunsigned("fp", 1)), "t": pivot_table(F.col("fp"))})
    keyed = table.withColumn("k", F.explode(keys)).select("k.m", "k.bits", "fp", "t")
    hubs = keyed.groupBy("m", "bits").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    hubs = hubs.withColumn("hub", F.explode(F.array("lo", "hi"))).select("m", "bits", "hub", pivot_table(F.col("hub")).alias("hub_t"))
    star = keyed.join(hubs, ["m", "bits"]).filter((F.col("fp") != F.col("hub")) & near(F.col("fp"), F.col("t"), F.col("hub"), F.col("hub_t"), max_bits))
    first = stored(components(star.select(F.col("fp").alias("u"), F.col("hub").alias("v"))), "stars")

    named = keyed.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, "named")
    mixed = named.groupBy("m", "bits", "component").agg(F.count("*").alias("n")).groupBy("m", "bits").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = named.join(mixed.drop("kinds"), ["m", "bits"])
    a = mixed.filter("component <> major").select("m", "bits", F.col("fp").alias("fa"), F.col("t").alias("ta"), F.col("component").alias("ca"))
    b = mixed.select("m", "bits", F.col("fp").alias("fb"), F.col("t").alias("tb"), F.col("component").alias("cb"), "major")
    met = a.join(b, ["m", "bits"]).filter((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("fa") < F.col("fb"))) & near(F.col("fa"), F.col("ta"), F.col("fb"), F.col("tb"), max_bits))
    links = met.select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct()
    second = stored(components(links), "merged")
    # every value of a first component follows its component; a value alone in the first may be linked by the second
    out = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "left")
    out = out.select(F.col("node").alias("fp"), F.coalesce("merged", "component").alias("component"))
    alone = second.join(first.select("node"), "node", "left_anti").select(F.col("node").alias("fp"), "component")
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, max_bits: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, component_id, component) of every row and the columns `keep`.

    component_id is the smallest id of its component, component the component's smallest fingerprint."""
    own = stored(fingerprints(docs, width, id_col, text_col, keep), "fingerprints", batch_bytes=8 << 20)
    values = stored(own.groupBy("fp").agg(F.min(id_col).alias("least")), "values")
    linked = near_components(values.select("fp"), max_bits)
    member = values.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id", "component")
    return own.join(named, "fp").select(id_col, "fp", "component_id", "component", *keep)
