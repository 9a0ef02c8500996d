"""Merkle manifest of a dataset as a postorder append log (operator 11).

A tree joins 16 nodes to one while more than one is left. Builders are aligned: each takes 256 consecutive nodes of a
tree, so two levels of it, and appends them in the order of their completion: 16 nodes, the node above them, the next
16, and at last the node above those. Such a page of the log is one row. The roots of pages are the nodes of the next
tier, which is built likewise, so there are as many rounds as the base-256 logarithm of the largest tree, each with a
256th of the rows before. A node's place follows from the sizes of the subtrees before it (`position`), in a page as in
the whole log, so siblings are addressed, not searched: a run's 16 nodes are neighbours, the nodes above them stand
17 apart. Proofs go down again from the top: a page gets the siblings above it once, for all that it holds.

Ranks within a source come from one range partition by (source, doc_id, leaf): rows of a task are numbered, counts of
tasks give the offsets. So a source with a third of all rows is many tasks and pages like any other, and no text is
shuffled: digests are made where the text is read. Each tier is written to the shared folder.

Defined results: null text, lang, source, n_chars or doc_id are `-` in a leaf; the null source is a part of its own
before all others, a null doc_id comes before all others of its source and is never tampered with; rows that repeat an
id are ordered by leaf, and equal rows are leaves each; a tampered text without A-Z has its old leaf and is verified;
a lone document of a lone source has an empty proof (the digest of nothing); an empty table gives no rows. Texts are
whole, of any length. Only the columns named are read, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import shuffle_parts, stored

FAN = 16
SPAN = FAN * FAN  # nodes of an aligned builder: it completes two levels
LEVELS = 15  # 16 ** 15 leaves fill a bigint
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def position(level: int, index: str, n: str, top: int = LEVELS) -> Column:
    """Place from 0 of node `index` of `level` in the log of a tree over `n` leaves with levels up to `top` (SQL expressions).

    Before it stand all nodes below that its own leaves and earlier ones complete, and, from its level up, those that
    earlier leaves alone complete."""
    end = f"least(({index} + 1) * {FAN**level}, {n})"
    below = [f"({end} + {FAN**a - 1}) div {FAN**a}" for a in range(level)]
    above = [f"{index} div {FAN ** (a - level)}" for a in range(level, top + 1)]
    return F.expr(f"cast({' + '.join(below + above)} AS bigint)")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(key, doc_id, digest, changed): a leaf a row, and its digest after tampering where `tampered` says so.

    `key` orders sources as text with the null source first."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    head = [field(F.col(c)) for c in FIELDS[:-1]]
    changed = F.when(tampered, digest(*head, field(text))) if tampered is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    return docs.select(key.alias("key"), "doc_id", digest(*head, field(F.col("text"))).alias("digest"), changed.alias("changed"))


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """`rows` with `rank` (from 0 by `order` within `key`) and `n` (rows of the key), without a task for a key."""
    placed = rows.repartitionByRange(shuffle_parts(rows.sparkSession), key, *order).sortWithinPartitions(key, *order)
    placed = stored(placed.withColumn("_row", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_row", 33))
    mine = Window.partitionBy(key)
    starts = placed.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    starts = starts.withColumns({"n": F.sum("_n").over(mine), "_before": F.sum("_n").over(mine.orderBy("_part")) - F.col("_n")})
    out = placed.join(starts, [key, "_part"]).withColumn("rank", F.col("_row") - F.col("_first") + F.col("_before"))
    return out.drop("_row", "_part", "_first", "_n", "_before")


def pages(items: DataFrame) -> DataFrame:
    """A page of the log a row: (key, block, n, m, payloads, nodes, root) of items (key, rank, n, digest, payload)."""
    grouped = items.groupBy("key", F.expr(f"rank div {SPAN}").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "digest", "payload"))).alias("x"))
    grouped = grouped.select("key", "block", "n", F.size("x").alias("m"), F.col("x.payload").alias("payloads"), F.col("x.digest").alias("low"))
    runs = F.expr(f"transform(sequence(0, (m - 1) div {FAN}), k -> slice(low, {FAN} * k + 1, {FAN}))")
    mid = F.transform("runs", lambda r: F.sha2(F.array_join(r, ""), 256))
    top = F.sha2(F.array_join("mid", ""), 256)
    nodes = F.flatten(F.transform("runs", lambda r, k: F.concat(r, F.array(F.get("mid", k)))))
    full = F.concat(nodes, F.array(F.col("top")))
    shaped = grouped.withColumn("runs", runs).withColumn("mid", mid).withColumn("top", top)
    return shaped.select(
        "key", "block", "n", "m", "payloads",
        F.when(F.col("n") == 1, F.col("low")).when(F.col("n") <= FAN, nodes).otherwise(full).alias("nodes"),
        F.when(F.col("n") == 1, F.get("low", F.lit(0))).when(F.col("n") <= FAN, F.get("mid", F.lit(0))).otherwise(F.col("top")).alias("root"),
    )


def grow(items: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of pages of each key's tree, and (key, tier, root) of all trees."""
    tiers, tops = [], None
    while True:
        page = stored(pages(items), "pages")
        found = page.filter(f"n <= {SPAN}").select("key", F.lit(len(tiers)).alias("tier"), "root")
        tops = found if tops is None else tops.unionByName(found)
        tiers.append(page)
        more = page.filter(f"n > {SPAN}")
        if more.isEmpty():
            return tiers, tops
        items = more.select("key", F.col("block").alias("rank"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("payload"))


def descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, rank, digest, payload, path, top) of every leaf; `tops` (key, tier, path, top) continues the path above each tree.

    A path holds the siblings of each level from the leaf upwards: those before and those after, each as one text."""
    below = None
    for t in reversed(range(len(tiers))):
        above = tops.filter(F.col("tier") == t).select("key", F.lit(0).cast("bigint").alias("block"), "path", "top")
        if below is not None:
            above = above.unionByName(below.select("key", F.col("rank").alias("block"), "path", "top"))
        page = tiers[t].withColumn("mids", F.when(F.col("n") > FAN, F.transform(F.expr(f"sequence(0, (m - 1) div {FAN})"), lambda k: _at("nodes", _mid_place(k)))))
        each = page.join(above, ["key", "block"]).select("key", "block", "n", "m", "nodes", "mids", "path", "top", F.posexplode("payloads").alias("i", "payload"))
        run, at = f"(i div {FAN})", f"(i % {FAN})"
        first = position(0, f"({run} * {FAN})", "m", 1)  # a run's nodes are neighbours in the log
        width = F.expr(f"least({FAN}, m - {run} * {FAN})")
        low = F.struct(
            F.array_join(F.slice("nodes", first + 1, F.expr(f"cast({at} AS int)")), "").alias("before"),
            F.array_join(F.slice("nodes", first + F.expr(f"{at} + 2"), width - F.expr(f"{at} + 1")), "").alias("after"),
        )
        mid = F.struct(
            F.array_join(F.expr(f"slice(mids, 1, cast({run} AS int))"), "").alias("before"),
            F.array_join(F.expr(f"slice(mids, cast({run} AS int) + 2, size(mids))"), "").alias("after"),
        )
        path = F.when(F.col("n") == 1, F.col("path")).when(F.col("n") <= FAN, F.concat(F.array(low), "path")).otherwise(F.concat(F.array(low, mid), "path"))
        digests = F.when(F.col("n") == 1, F.get("nodes", F.lit(0))).otherwise(_at("nodes", position(0, "i", "m", 1)))
        below = each.select("key", (F.col("block") * SPAN + F.col("i")).alias("rank"), digests.alias("digest"), "payload", path.alias("path"), "top")
        if t:
            below = stored(below, "paths")
    return below


def _at(array: str, place: Column) -> Column:
    return F.get(F.col(array), place.cast("int"))


def _mid_place(k: Column) -> Column:
    """`position(1, k, m, 1)` of a lambda's index: the run's leaves and those before it, and the nodes above the earlier runs."""
    return F.least((k + 1) * FAN, F.col("m")) + k


def fold(leaf: Column, path: Column) -> Column:
    """The root that `leaf` gives with the siblings of `path`."""
    return F.aggregate(path, leaf, lambda x, s: digest(s["before"], x, s["after"]))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The log's tiers of pages, and (key, doc_id, leaf, changed, subroot, root, path) of every document."""
    rows = ranked(leaves(docs, tampered), "key", "doc_id", "digest")
    tiers, subroots = grow(rows.select("key", "rank", "n", "digest", F.struct("doc_id", "changed").alias("payload")))
    sources = ranked(stored(subroots, "subroots").withColumn("all", F.lit("-")), "all", "key")
    upper, roots = grow(sources.select(F.col("all").alias("key"), "rank", "n", F.col("root").alias("digest"), F.struct("key", "tier").alias("payload")))
    empty = F.array().cast("array<struct<before: string, after: string>>")
    above = descend(upper, roots.select("key", "tier", empty.alias("path"), F.col("root").alias("top")))
    tops = above.select("payload.key", "payload.tier", "path", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"))
    each = descend(tiers, stored(tops, "tops"))
    return tiers, each.select("key", "payload.doc_id", F.col("digest").alias("leaf"), "payload.changed", "top.subroot", "top.root", "path")


def log(tiers: list[DataFrame]) -> DataFrame:
    """(key, position, level, index, digest): the append log of each key's tree, a row a node, from its pages."""
    total = tiers[0].groupBy("key").agg(F.first("n").alias("total"))
    out = None
    for t, page in enumerate(tiers):
        high = F.expr(f"if(n = 1, 0, if(n <= {FAN}, 1, 2))")
        each = page.withColumn("high", high).select("key", "block", "m", "high", F.explode(F.expr("sequence(0, high)")).alias("own"), "nodes")
        each = each.withColumn("count", F.expr(f"case own when 0 then m when 1 then (m + {FAN - 1}) div {FAN} else 1 end").cast("int"))
        each = each.select("*", F.explode(F.expr("sequence(0, count - 1)")).alias("i"))
        place = [position(a, "i", "m", 1).cast("int") for a in (0, 1)]
        spot = F.when(F.col("high") == 0, F.lit(0)).when(F.col("own") == 0, place[0]).when(F.col("own") == 1, place[1]).otherwise(F.size("nodes") - 1)
        rows = each.select("key", (F.col("own") + 2 * t).alias("level"), (F.col("block") * F.expr(f"shiftright({SPAN}, 4 * own)") + F.col("i")).alias("index"), F.get("nodes", spot).alias("digest"))
        rows = rows if not t else rows.filter(f"level > {2 * t}")  # a tier's lowest nodes are the roots of the one below
        out = rows if out is None else out.unionByName(rows)
    places = F.coalesce(*(F.when(F.col("level") == a, position(a, "index", "total")) for a in range(2 * len(tiers) + 1)))
    return out.join(total, "key").select("key", places.alias("position"), "level", "index", "digest")


def verification(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), with every fifth crc32 of an id tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    _, rows = manifest(docs, tampered)
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8) -> str:
    """DuckDB SQL of `verification`, for at most 16 ** levels documents a source and as many sources."""
    as_field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    head = " || ".join(map(as_field, FIELDS[:-1]))
    step = "xor(c >> 1, (c & 1) * 3988292384)"
    crc = f"xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: [ascii(s)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, v: list_transform([xor(a, v)], lambda c: {step})[1]), 4294967295::UBIGINT)"
    parts = [
        f"d AS (SELECT doc_id, coalesce('s' || source, '-') AS k, sha256({head} || {as_field('text')}) AS h, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {as_field(f'''translate(text, '{UPPER}', '{LOWER}')''')}) END AS changed FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d)",
    ]
    for side, first in (("s", "s0"), ("r", "r0")):
        for a in range(levels):
            parts.append(f"{side}{a + 1} AS (SELECT k, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, count(*) OVER (PARTITION BY k) AS n FROM {side}{a} WHERE n > 1 GROUP BY k, i // 16)")
        tops = " UNION ALL ".join(f"SELECT k, h FROM {side}{a} WHERE n = 1" for a in range(levels + 1))
        parts.append(f"{side}_top AS ({tops})")
        if side == "s":
            parts.append("r0 AS (SELECT '-' AS k, k AS source_key, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM s_top)")
    parts.append("p0 AS (SELECT s0.doc_id, s0.h AS leaf, s0.k, s0.i, r0.i AS ri, r0.h AS subroot, r_top.h AS root, '' AS proof, coalesce(s0.changed, s0.h) AS folded, row_number() OVER () AS id FROM s0 JOIN r0 ON r0.source_key = s0.k CROSS JOIN r_top)")
    at = 0
    for side, key, i in (("s", "p.k", "p.i"), ("r", "'-'", "p.ri")):
        for a in range(levels):
            mine = f"({i} // {16**a})"
            parts.append(
                f"p{at + 1} AS (SELECT p.doc_id, p.leaf, p.k, p.i, p.ri, p.subroot, p.root, p.id, max(p.proof) || coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i <> {mine}), '') AS proof, "
                f"CASE WHEN count(q.i) > 0 THEN sha256(coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i < {mine}), '') || max(p.folded) || coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i > {mine}), '')) ELSE max(p.folded) END AS folded "
                f"FROM p{at} p LEFT JOIN {side}{a} q ON q.k = {key} AND q.n > 1 AND q.i // 16 = {i} // {16 ** (a + 1)} GROUP BY ALL)"
            )
            at += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM p{at}"


ORACLE = oracle()
