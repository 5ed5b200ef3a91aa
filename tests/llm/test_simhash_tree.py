import random
import re

import xxhash
from helpers import DOCS, by_id, docs_of, words

import __spark_entry__ as entry
from gradeframe.llm import simhash_tree as S


def restated_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def restated_components(prints):
    """Smallest id by comparing all pairs of ``(id, fingerprint)``."""
    low = [i for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if low[a] > low[b] and bin((x ^ y) & (1 << 64) - 1).count("1") <= 4:
                    low[a], changed = low[b], True
    return low


EDGES = [None, "", " \t\n", "One", "one two three", "ONE two three four", "a\x0bb\x1fc d e É", "x " * 70_000]


def test_fingerprints(spark, data):
    docs = docs_of(spark, EDGES).union(spark.read.parquet(f"{data}/documents.parquet").limit(60))
    rows = docs.select("text", S.fingerprints("text").alias("fp")).collect()
    assert [r.fp for r in rows] == [restated_print(r.text) for r in rows]


def test_shards_link_all_and_only_what_is_near():
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        for _ in range(3):
            flips = rng.sample(range(64), rng.randrange(1, 7))
            values.append(v ^ sum(1 << f for f in flips))
    for sides in ([0] * len(values), [i % 2 for i in range(len(values))]):
        links = S.shard_links(values, sides, 4)
        assert all((values[a] ^ values[b]).bit_count() <= 4 for a, b in links)
        groups = {i: {i} for i in range(len(values))}
        for pairs in (links, None):
            if pairs is None:
                pairs = [
                    (a, b)
                    for a in range(len(values))
                    for b in range(a)
                    if (values[a] ^ values[b]).bit_count() <= 4 and (not any(sides) or sides[a] != sides[b])
                ]
                before = {i: frozenset(g) for i, g in groups.items()}
            for a, b in pairs:
                if groups[a] is not groups[b]:
                    groups[a] |= groups[b]
                    for i in groups[a]:
                        groups[i] = groups[a]
        assert before == {i: frozenset(g) for i, g in groups.items()}


def test_keys_meet_within_the_radius(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        v = rng.getrandbits(64)
        w = v ^ sum(1 << f for f in rng.sample(range(64), 4))
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (v, w)))
    df = spark.createDataFrame(rows, "a long, b long")
    df = df.select(S.shard_keys("a", 4).alias("x"), S.shard_keys("b", 4).alias("y"))
    assert df.where("not arrays_overlap(x, y)").count() == 0


def test_query_equals_brute_force(spark, data):
    found = entry.queries()["op5_simhash_trees"](spark, data).orderBy("doc_id").collect()
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in found]
    assert [r.component_id for r in found] == restated_components(prints)


def test_hot_shards_are_cut_without_losing_links(spark):
    base = words(200, 1)
    texts = [" ".join(base[:i] + [f"z{i}"] + base[i + 1 :]) for i in range(60)] + ["other text here now"] * 3
    docs = docs_of(spark, texts)
    found = S.near_duplicates(docs, shard_rows=4).orderBy("doc_id").collect()
    want = restated_components([(r.doc_id, r.fp) for r in found])
    assert [r.component_id for r in found] == want
    assert len(set(want)) < 60


def test_edge_cases(spark):
    docs = docs_of(spark, ["same words in all", None, "", "same words in all", "SAME words in all"], first=10)
    extra = spark.createDataFrame([(None, "same words in all"), (11, None)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "1 as fp", "2 as component_id").unionByName(
        extra.selectExpr("doc_id", "text", "1 as fp", "2 as component_id")
    )
    found = S.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == [
        (10, 10), (11, 11), (11, 11), (12, 11), (13, 10), (14, 10),
    ]
    assert [r.component_id for r in found if r.doc_id is None] == [10]
    empty = spark.createDataFrame([], DOCS)
    assert S.near_duplicates(empty).count() == 0
    assert S.drop_near_duplicates(empty).count() == 0
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    # the copy without an id goes as well
    assert sorted(kept.collect(), key=str) == sorted([(10, "same words in all", 1, 2), (11, None, 1, 2)], key=str)
    alone = spark.createDataFrame([(None, "own words of it"), (None, "own words of it")], "doc_id long, text string")
    assert S.drop_near_duplicates(alone).count() == 1


def test_all_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in S.near_duplicates(docs).collect()] == [None, None]
    assert by_id(S.near_duplicates(docs.selectExpr("cast(3 as long) as doc_id", "text")))[3].component_id == 3
