import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradeframe.catalog import stubs
from gradeframe.functions.parsing import SELF_SOLVE
from gradeframe.operators import generation as N, rollouts as D
from gradeframe.plans import generation as RUN, training as T


def recording_model(folder):
    """A model that leaves one file per call, named by the number of prompts."""

    def factory():
        import os
        import uuid

        def run(prompts, n):
            open(os.path.join(folder, f"{len(prompts)}-{n}-{uuid.uuid4().hex}"), "w").close()
            return [[f"{p}/{i}" for i in range(n)] for p in prompts]

        return run

    return factory


def calls(folder):
    import os

    return sorted(tuple(map(int, name.split("-")[:2])) for name in os.listdir(folder))


def test_outputs_keep_their_row(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    table = spark.range(10).coalesce(1).withColumn("p", F.col("id").cast("string"))
    out = N.generate(table, "p", recording_model(str(tmp_path / "calls")), 2, batch_size=4)
    out.write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("id", "generation")) == [(i, [f"{i}/0", f"{i}/1"]) for i in range(10)]
    assert got.filter("avg_generation_time >= 0").count() == 10


def test_call_counts(spark, tmp_path):
    table = spark.range(10).coalesce(1).withColumn("p", F.col("id").cast("string"))
    batch, single = tmp_path / "a", tmp_path / "b"
    batch.mkdir(), single.mkdir()
    N.generate(table, "p", recording_model(str(batch)), 3, batch_size=4).write.format("noop").mode("overwrite").save()
    assert calls(str(batch)) == [(2, 3), (4, 3), (4, 3)]
    N.generate(table, "p", recording_model(str(single)), 3, per_call=True).write.format("noop").mode("overwrite").save()
    assert calls(str(single)) == [(1, 1)] * 30


def test_errors_become_texts_for_their_own_prompt(spark):
    def factory():
        def run(prompts, n):
            if "3" in prompts:
                raise RuntimeError("refused")
            return [[p] * n for p in prompts]

        return run

    table = spark.range(6).withColumn("p", F.col("id").cast("string"))
    got = {r["id"]: r["generation"] for r in N.generate(table, "p", factory, 2).collect()}
    assert got[3] == ["Error: refused"] * 2 and got[2] == ["2", "2"]
    with pytest.raises(Exception):
        N.generate(table, "p", factory, 2, capture=False).collect()


def test_replies_of_another_length_become_errors_of_their_own_prompt(spark):
    asked = []

    def factory():
        def run(prompts, n):
            asked.extend(prompts)
            return [[p] * (n if p != "3" else 1) for p in prompts]

        return run

    table = spark.range(6).coalesce(1).withColumn("p", F.col("id").cast("string"))
    got = {r["id"]: r["generation"] for r in N.generate(table, "p", factory, 2).collect()}
    assert got[3] == ["Error: 1 texts in the reply, 2 were asked for"] * 2 and got[2] == ["2", "2"]
    few = {r["id"]: r["generation"] for r in N.generate(table, "p", lambda: lambda prompts, n: [], 1).collect()}
    assert all(texts == ["Error: 0 replies to 1 prompts"] for texts in few.values())
    with pytest.raises(Exception):
        N.generate(table, "p", factory, 2, capture=False).collect()
    answers = N._answer(factory(), ["1", "3", "4"], 2, True)
    assert asked == ["1", "3", "4"] and [a[0]["generation"] for a in answers] == ["1", got[3][0], "4"]


def test_decisions_and_rollouts_keep_the_columns_of_their_input(spark):
    from gradeframe.plans import generation as P

    table = spark.createDataFrame([("q", 1.5)], "question string, avg_generation_time double")
    model = lambda: lambda prompts, n: [["<decision>SELF_SOLVE</decision>"] * n for _ in prompts]
    for out in (P.decide(table, model, "math"), P.rollouts(table, model, "math", 2)):
        assert out.select("avg_generation_time").first()[0] == 1.5


def test_finished_rows_are_not_asked_again(spark):
    table = spark.createDataFrame(
        [(1, "a", ["kept"]), (2, "b", None), (3, "c", ["Error: x"])], "i int, p string, g array<string>"
    )
    echo = lambda: lambda prompts, n: [[p] * n for p in prompts]
    again = N.generate(table, "p", echo, 1, "g")
    assert rows(again.select("i", "g")) == [(1, ["kept"]), (2, ["b"]), (3, ["c"])]
    nulls = N.generate(table, "p", echo, 1, "g", retry="null_only")
    assert rows(nulls.select("i", "g")) == [(1, ["kept"]), (2, ["b"]), (3, ["Error: x"])]
    assert rows(N.pending(table, "g").select("i")) == [(2,), (3,)]
    assert rows(N.pending(table, "g", "null_only").select("i")) == [(2,)]


def test_mcq_answers_carry_order_and_letter(spark):
    table = spark.createDataFrame([(i, f"q{i}", list("wxyz"), i % 4) for i in range(8)], "id long, question string, options array<string>, answer_index int")

    def reader():
        """Answers with the letter shown before the option w."""

        def run(prompts, n):
            return [[line[1] for line in p.splitlines() if line.endswith(") w")] for p in prompts]

        return run

    got = RUN.answer_mcq(table, reader, ["id"], 3)
    for r in got.collect():
        assert len(r["attempts"]) == 3
        for a in r["attempts"]:
            assert a["shuffled_order"][ord(a["generation"]) - 65] == 0
            assert a["shuffled_order"][ord(a["correct_label"]) - 65] == r["answer_index"]
    from gradeframe.operators.grading import grade

    graded = grade(got, "attempts", "science")
    assert {r["id"]: r["is_correct"] for r in graded.collect()} == {i: int(i % 4 == 0) for i in range(8)}


def test_rationales_fill_only_what_is_missing(spark):
    table = spark.createDataFrame(
        [(1, "q1", 1, "old", "Error: x"), (2, "q2", 0, None, "fine")],
        "i int, question string, is_correct int, label_0_analysis string, label_1_analysis string",
    )
    echo = lambda: lambda prompts, n: [[p.splitlines()[-1]] * n for p in prompts]
    got = {r["i"]: r for r in RUN.rationales(table, echo, "teacher").collect()}
    assert got[1]["label_0_analysis"] == "old" and SELF_SOLVE in got[1]["label_1_analysis"]
    assert "DELEGATE" in got[2]["label_0_analysis"] and got[2]["label_1_analysis"] == "fine"
    own = {r["i"]: r["routing_analysis"] for r in RUN.rationales(table, echo, "self").collect()}
    assert SELF_SOLVE in own[1] and "DELEGATE" in own[2]


def test_rollouts_in_both_forms(spark):
    table = spark.range(30).withColumn("question", F.concat(F.lit("q"), F.col("id").cast("string")))
    texts = RUN.rollouts(table, stubs.decision_model, "math", 5)
    prompted = table.withColumn("p", RUN.P.decision_prompt(RUN.domain_query(table, "math")))
    long = N.generate(prompted, "p", stubs.decision_model, 5, "g").select("id", F.posexplode("g").alias("attempt", "rollout"))
    columns = ["id", "count_0", "count_1", "count_invalid", "example_0", "example_1"]
    assert rows(texts.select(columns)) == rows(D.rollout_counts(long, ["id"]).select(columns))
    kept = RUN.build_diversified(table, stubs.decision_model, "math", 5)
    report = D.diversity_report(RUN.diversity_counts(table, stubs.decision_model, "math", 5)).first()
    assert report["n_kept"] == kept.count() and report["n_total"] == 30
    none = D.diversity_report(D.diversity_columns(texts).filter("false")).first()
    assert none["kept_pct"] is None and none["delegate_pct"] is None


def test_training_tables(spark):
    graded = spark.createDataFrame([(1, "q", None, 1, "since"), (2, "r", ["u", "v"], 0, None)], "i int, question string, options array<string>, is_correct int, analysis string")
    ready = T.with_choices(graded.withColumn("choices", F.lit("given")))
    assert rows(ready.select("i", "choices")) == [(1, "given"), (2, "(A) u\n(B) v")]
    pairs = T.render_pairs(ready, "science", "teacher", "<u>", "<a>", "<e>", keep=["i"]).orderBy("i").collect()
    assert pairs[0]["prompt"].startswith("<u>") and pairs[0]["prompt"].endswith("given<a>")
    assert pairs[0]["completion"] == "<analysis>\nsince\n</analysis>\n\n<decision>\nSELF_SOLVE\n</decision><e>"
    assert "<analysis>\n\n</analysis>" in pairs[1]["completion"]
    label = T.render_pairs(graded, "math", "label")
    assert label.columns == ["prompt", "completion"]
    assert label.first()["completion"] == "<decision>\nSELF_SOLVE\n</decision>"
    with pytest.raises(ValueError):
        T.render_pairs(graded, "science", "label")
    with pytest.raises(ValueError):
        T.render_pairs(graded, "math", "other")
    words = lambda: lambda texts: [len(t.split()) for t in texts]
    lengths = spark.createDataFrame([("a b", "c"), ("a", ""), (None, "x")], "prompt string, completion string")
    assert T.fits(lengths, 1, words).count() == 1
    assert rows(T.length_report(lengths, 1)) == [(3, 2, 1)]
    assert rows(T.token_length_report(lengths, "prompt", words)) == [(2, 1.5)]
    assert rows(T.token_length_report(lengths.filter("false"), "prompt")) == [(0, 0.0)]


def test_reward_report(spark):
    table = spark.createDataFrame([(1, "SELF_SOLVE", 1), (1, "what", 1), (2, "DELEGATE", 0)], "step int, completion string, is_correct int")
    assert rows(D.reward_report(D.with_reward(table))) == [(1, 2, 1, 1, 0.0), (2, 1, 1, 0, 1.0)]


def test_models_are_chosen_by_name():
    assert N.choose_model({"Stub": stubs.text_model}, "stub") is stubs.text_model
    with pytest.raises(ValueError):
        N.choose_model({"Stub": stubs.text_model}, "other")
