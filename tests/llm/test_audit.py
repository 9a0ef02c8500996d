import random
from collections import Counter
from itertools import permutations

import duckdb

from statloom.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def fails(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
    }


def brute(docs, labels):
    """Every order applied filter by filter."""
    out = []
    ids = {}
    for i, t, *_ in docs:
        ids.setdefault(t or "", []).append(i)
    rows = []
    for i, t, _, source, _ in docs:
        f = fails(t or "") | {"E": i is not None and any(j is not None and j < i for j in ids[t or ""])}
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((source or "", f, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    for part in {r[0] for r in rows}:
        own, shapley, lines = [r for r in rows if r[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r in left if r[1][c]]
                kept = [r for r in left if not r[1][c]]
                redundant = sum(r[1][c] for r in own) - len(gone)
                unique = sum(r[1][c] and sum(r[1].values()) == 1 for r in own)
                shapley[c] += len(gone)
                lines.append((part, "".join(order), step, len(kept), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)))
                left = kept
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def cases():
    rng = random.Random(6)
    docs = []
    for i in range(300):
        n = rng.choice([0, 3, 199, 200, 250])
        words = [rng.choice(["alpha", "Beta", "c#", "É", "x|y", "w"]) if rng.random() < 0.1 else (f"w{k}" if rng.random() < 0.6 else "the") for k in range(n)]
        docs.append((i, rng.choice([" ", "\n", "\x0b "]).join(words), "en", rng.choice(["s", "t", "", None]), 1))
    docs += [(1000 + i, docs[rng.randrange(300)][1], "en", rng.choice(["s", "hot"]), 1) for i in range(200)]
    docs += [(2000, None, None, None, None), (2001, None, None, "hot", None), (None, docs[4][1], None, "s", 1), (None, None, None, None, None), (5, docs[5][1], "en", "s", 1), (5, docs[5][1], "en", docs[5][3], 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1200, 2)] + [(10, 1, 1), (10, 0, 0), (None, 1, 1)]
    return docs, labels


def test_audit_and_sql_match_brute_force(spark, tmp_path):
    docs, labels = cases()
    d = spark.createDataFrame(docs, DOCS)
    x = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(docs, labels)
    clashing = d.selectExpr("*", "'q' AS part", "1 AS h", "2 AS mask", "3 AS n")
    got = audit.audit(clashing, x.selectExpr("*", "'z' AS part", "5 AS n"))
    assert got.columns == ["part", "filter_order", "step", *audit.NOT_LOST]
    assert sorted(map(tuple, got.collect())) == want
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    x.write.parquet(f"file://{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(audit.ORACLE).fetchall()) == want


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = audit.audit(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS), labels).collect()
    assert len(one) == 600 and all(r.unique_fails == (r.filter_order[r.step - 1] == "A") for r in one)
