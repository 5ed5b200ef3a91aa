"""Every stage against a brute-force version on its own input."""

import hashlib

import test_bpe_tree as bpe
import test_decontaminate as leaks
import test_line_dedup as lines
import test_simhash_tree as near
from gradeframe.llm.storage import written
from helpers import docs_of

import __spark_entry__ as entry
import corpus_pipeline as pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_take_effect_one_after_the_other(spark, data, tmp_path):
    folder = str(tmp_path)
    whole = spark.read.parquet(f"{data}/documents.parquet")
    part = whole.where("doc_id < 70")
    part.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    docs, seen = part, [part]
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        seen.append(docs)
        assert docs.columns[:5] == COLUMNS
    raw, good, deduped, single, clean, tokens = seen

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, after = texts(raw), texts(good)
    known = [i for i in before if i in labels]
    assert sum((i in after) == bool(labels[i]) for i in known) >= 0.9 * len(known)
    assert all(after[i] == before[i] for i in after)

    # the operator itself is held against edit similarity in its own tests
    assert texts(deduped) == {i: t for i, t, _, _ in lines.found(good)}
    assert all(r.n_chars == len(r.text) for r in deduped.collect() if r.text != before[r.doc_id])

    rows = sorted(texts(deduped).items())
    roots = near.restated_components([(i, near.restated_print(t)) for i, t in rows])
    assert set(texts(single)) == {i for (i, _), root in zip(rows, roots) if i == root}

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    found = leaks.restated(sorted(texts(single).items()), items)
    assert set(texts(clean)) == set(texts(single)) - {i for i, _ in found}

    for r in tokens.collect():
        assert list(r.ids) == bpe.public(r.text) and r.n_tokens == len(r.ids)
    assert texts(tokens) == texts(clean)
    again = entry.queries()["pipeline"](spark, folder)
    assert sorted(map(str, again.collect())) == sorted(map(str, tokens.collect()))


def test_stages_take_nulls_and_empty_tables(spark, data):
    rows = docs_of(spark, [None, "", "plain words in a row here", None])
    odd = rows.selectExpr("if(doc_id = 3, null, doc_id) as doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    for docs in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, data), "test-odd")
            assert docs.columns[:5] == COLUMNS
    assert docs.count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_rows_without_ids_and_clashing_columns(spark, data):
    """Leaks and copies without an id go, columns named like the operators' own pass, repeated rows are one."""
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("text is not null").first().text
    story = " ".join(f"Word{i} of the story" for i in range(30))
    rows = [(1, story), (None, story), (None, f"Some text. {item}"), (2, f"{item} More."), (3, "Own words, here and there."), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.selectExpr("*", "7 as n_lines", "8 as n_removed", "9 as own", "10 as low", "11 as _row", "12 as _a", "13 as fp")
    odd = odd.union(odd)
    stages = dict(pipeline.STAGES)
    for name, kept in (("near_duplicates", 5), ("decontamination", 8)):
        out = written(stages[name](spark, odd, data), f"test-{name}")
        assert out.columns == odd.columns and out.count() == kept
        assert out.where("n_lines = 7 and n_removed = 8 and own = 9 and low = 10 and `_row` = 11 and fp = 13").count() == kept
    assert written(stages["decontamination"](spark, odd, data), "test-leaks").where("doc_id is null and text is not null").count() == 2
    out = written(stages["line_dedup"](spark, odd, data), "test-lines")
    assert out.where("n_lines = 7 and n_removed = 8 and own = 9").count() == 12
    long = spark.createDataFrame([(i, "word " * 5_000 + str(i), "en", "s", 1) for i in range(2)], docs.schema)
    for name, stage in pipeline.STAGES[:4]:
        assert written(stage(spark, long, data), f"test-long-{name}").count() <= 2


def test_line_stage_leaves_out_no_alike_line(spark):
    """Lines with a changed letter in nearly every word share no bucket."""
    line = " ".join(f"word{i}x{i * 7919 % 1000}" for i in range(40))
    other = "".join("q" if i % 11 == 5 and c != " " else c for i, c in enumerate(line))
    docs = docs_of(spark, [line, f"{other}\nanother line of this text"])
    assert texts(pipeline.without_repeated_lines(spark, docs, "")) == {0: line, 1: "another line of this text"}
