import random
import re
from collections import Counter

import duckdb
from helpers import DOCS, docs_of, words

import __spark_entry__ as entry
from gradeframe.llm import decontaminate as D

ITEMS = "item_id long, text string"
BETWEEN = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\xbf -⁯　-〿]+")


def shingles(text, size=5):
    w = [x for x in BETWEEN.split((text or "").lower()) if x]
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def restated(docs, items, similarity=0.8):
    """The best window of every document for every item, from all windows."""
    out = {}
    for i, t in docs:
        own = shingles(t)
        for j, u in items:
            item = shingles(u)
            if not item or i is None and t is None:
                continue
            best = 0
            for start in range(len(own)):
                window = Counter(own[start : start + len(item)])
                shared = sum((window & Counter(item)).values())
                score = shared / (sum(window.values()) + len(item) - shared)
                best = max(best, score)
                if own[start] in item and score >= similarity - 1e-12 and score > out.get((i, j), (0, 0))[0] + 1e-12:
                    out[i, j] = (score, start)
            # no window that starts elsewhere is better
            assert best < similarity - 1e-12 or abs(best - out[i, j][0]) < 1e-12
    return {k: (round(s, 9), at) for k, (s, at) in out.items()}


def found(docs, items, **options):
    rows = D.contaminated(docs, items, **options).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in rows}


def planted(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(words(rng.randrange(4, 90), seed * 100 + k, 60 if k % 3 == 0 else 3000))) for k in range(25)]
    items.append((99, items[3][1]))
    docs = []
    for i in range(60):
        text = words(rng.randrange(0, 80), seed * 1000 + i)
        for _ in range(rng.randrange(0, 3)):
            piece = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.choice([0, len(piece) - 1, rng.randrange(len(piece))])
                piece[at : at + rng.choice([0, 1])] = [f"z{rng.randrange(9)}"] * rng.choice([0, 1])
            cut = rng.randrange(len(text) + 1)
            text = text[:cut] + piece + text[cut:]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).title()))
    return docs, items


def test_planted_items_equal_brute_force(spark):
    for seed in (1, 2):
        docs, items = planted(seed)
        want = restated(docs, items)
        got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
        assert got == want and len(want) > 30 and any(s < 1 for s, _ in want.values())


def test_query_equals_its_twin(spark, data):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    theirs = con.execute(entry.oracle_sql()["op2_decontaminate"])
    names = [d[0] for d in theirs.description]
    mine = entry.queries()["op2_decontaminate"](spark, data).select(*names).collect()
    assert sorted(tuple(r) for r in mine) == sorted(theirs.fetchall()) and mine


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << f for f in rng.sample(range(64), D.RADIUS))
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "p long, q long")
    near = D.RADIUS // D.BLOCKS
    df = df.select(D.block_values("p", D.BLOCKS, near).alias("x"), D.block_values("q", D.BLOCKS, 0).alias("y"))
    assert df.where("not arrays_overlap(x, y)").count() == 0


def test_edge_cases(spark):
    item = " ".join(words(30, 5))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too few words"), (None, item)], ITEMS)
    rows = [(7, f"x {item} y"), (7, f"x {item} y"), (None, item), (8, None), (9, ""), (10, "plain"), (11, "ab " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as item_id", "2 as similarity", "3 as start", "4 as n", "5 as hash")
    assert found(docs, items) == {(i, j): (1.0, at) for i, at in ((7, 1), (None, 0)) for j in (1, None)}
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [8, 9, 10, 11]  # the leak without an id goes too
    assert D.contaminated(spark.createDataFrame([], DOCS), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.clean(docs, items.limit(0)).count() == len(rows)


def test_main_path_runs_no_python(spark, data, capsys):
    from conftest import plan_of

    plan = plan_of(entry.queries()["op2_decontaminate"](spark, data), capsys)
    assert "Python" not in plan and "Pandas" not in plan and "Nested" not in plan and "Cartesian" not in plan


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs, items = planted(3)
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    want = found(docs, items)
    monkeypatch.setattr("gradeframe.llm.measured.BROADCAST_ROWS", 0)
    assert found(docs, items) == want
    assert docs_of(spark, ["a"]).count() == 1


def by_sql(docs, items):
    """The query's SQL twin over given rows."""
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    rows = con.execute(f"SELECT doc_id, item_id, similarity, start FROM ({entry.oracle_sql()['op2_decontaminate']})").fetchall()
    return {(i, j): (round(s, 9), at) for i, j, s, at in rows}


def test_repetitive_items_equal_the_sql(spark):
    """Items of two, three and four words in turn, against documents that hold them from another word on."""
    rng = random.Random(7)
    docs, items = [], []
    for k in range(240):
        turn = [f"q{k}x{j}" for j in range(2 + k % 3)]
        n = rng.randrange(9, 20)
        items.append((k, " ".join((turn * n)[:n])))
        shift = rng.randrange(len(turn))
        piece = (turn * n)[shift : shift + n]
        docs.append((k, " ".join(words(rng.randrange(9), k) + piece + words(rng.randrange(9), k + 999))))
    want = by_sql(docs, items)
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    assert got == want and len(want) > 200
