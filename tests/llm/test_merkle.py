import random
import zlib
from hashlib import sha256

import duckdb
from pyspark.sql import functions as F

from statloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [*row[:4], row[4] if text is None else text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Levels from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, i):
    """(before, after) of each level from leaf i."""
    path = []
    for level in levels[:-1]:
        start = i // 16 * 16
        path.append(("".join(level[start:i]), "".join(level[i + 1 : start + 16])))
        i //= 16
    return path


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in order]) if order else None
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = climb(trees[s], i) + climb(top, j)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            x = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if hit else leaf(r)
            for before, after in path:
                x = h(before, x, after)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*(b + a for b, a in path)), x, x == root))
    return sorted(out, key=str)


def rows_of(sizes, seed=0):
    rng, out = random.Random(seed), []
    for name, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "no capitals", "Some Text", "É long " * rng.randint(1, 60)])
            out.append((len(out), name, rng.choice([None, "en", "de"]), None if text is None else len(text), text))
    rng.shuffle(out)
    return out


def test_every_tree_shape_matches_brute_force(spark):
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "c": 256, "d": 257, "é": 600, "z": 2, "src": 33, "Z": 255}
    rows = rows_of(sizes)
    rows += [(None, "b", None, None, "X"), (None, "b", None, None, "Y"), (7, "a", "en", 1, "q"), (7, "a", "en", 1, "q")]  # null and repeated ids
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS rank", "2 AS digest", "3 AS payload")
    assert sorted(map(tuple, merkle.verification(docs).collect()), key=str) == brute(rows)


def test_many_sources_and_three_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 16 * 16)
    rows = rows_of({f"s{i}": 1 + i % 3 for i in range(300)}, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, merkle.verification(docs).collect()), key=str) == brute(rows)
    n = 66_000  # over 16 ** 4, so three tiers
    base = spark.range(n).selectExpr("'-' AS key", "id AS rank", f"{n}L AS n", "sha2(cast(id AS string), 256) AS digest", "struct(id) AS payload")
    tiers, tops = merkle.grow(base)
    levels = tree([h(str(i)) for i in range(n)])
    assert len(tiers) == 3 and tops.first().root == levels[-1][0]
    empty = F.array().cast("array<struct<before: string, after: string>>")
    got = merkle.descend(tiers, tops.select("key", "tier", empty.alias("path"), F.col("root").alias("top")))
    assert got.filter(merkle.fold(F.col("digest"), F.col("path")) != F.col("top")).isEmpty() and got.count() == n
    for r in got.filter("rank IN (0, 15, 16, 255, 256, 65535, 65536, 65999)").collect():
        assert [tuple(s) for s in r.path] == climb(levels, r.rank) and r.digest == h(str(r.rank))


def test_log_is_in_order_of_completion(spark):
    for n in (1, 2, 16, 17, 256, 257, 300, 5000):
        done, levels = [], tree([str(i) for i in range(n)])
        counts = [0] * len(levels)

        def complete(level):
            done.append((level, counts[level]))
            counts[level] += 1
            up = level + 1
            if up < len(levels) and (counts[level] % 16 == 0 or counts[level] == len(levels[level])):
                complete(up)

        for _ in range(n):
            complete(0)
        items = spark.range(n).selectExpr("'-' AS key", "id AS rank", f"{n}L AS n", "cast(id AS string) AS digest", "struct(id) AS payload")
        log = merkle.log(merkle.grow(items)[0]).orderBy("position").collect()
        assert [r.position for r in log] == list(range(len(done)))
        assert [(r.level, r["index"]) for r in log] == done
        assert [r.digest for r in log] == [levels[a][i] for a, i in done]


def test_empty_table_and_lone_document(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.verification(docs).collect() == []
    r = merkle.verification(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == h("-----") and r.proof_sha256 == h() and r.verified


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = [r for r in rows_of({"a": 20, "b": 300, None: 1, "c": 1}, 3)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(merkle.ORACLE).fetchall(), key=str) == brute(rows)
