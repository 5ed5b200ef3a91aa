import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradeframe.catalog import fixtures as fx, stubs
from gradeframe.plans.generation import answer_questions
from gradeframe.streaming import incremental as I


def answer(df):
    return answer_questions(df, stubs.number_model, "math", 1).select("qid", F.get("generation", 0).alias("g"))


def test_second_run_takes_only_what_is_left(spark, data, tmp_path):
    questions = fx.questions(spark, data).select("qid", "question", "decision")
    path = str(tmp_path / "out")
    seen = []

    def job(df):
        seen.append(df.count())
        return answer(df)

    first = I.run_incremental(questions.filter("decision = 1"), path, job, ["qid"], "g")
    n_first = first.count()
    whole = I.run_incremental(questions, path, job, ["qid"], "g")
    assert seen == [n_first, questions.count() - n_first]
    assert whole.count() == whole.select("qid").distinct().count() == questions.count()
    assert rows(whole.select("qid", "g")) == rows(answer(questions))
    I.run_incremental(questions, path, job, ["qid"], "g")
    assert seen[-1] == 0


def test_errors_are_retried(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    path = str(tmp_path / "out")

    def broken(df):
        return df.select("k", F.when(F.col("k") == 1, "Error: x").otherwise("ok").alias("g"))

    def sound(df):
        return df.select("k", F.lit("fine").alias("g"))

    I.run_incremental(table, path, broken, ["k"], "g")
    kept = I.run_incremental(table, path, sound, ["k"], "g", retry="null_only")
    assert rows(kept.select("k", "g")) == [(1, "Error: x"), (2, "ok")]
    fixed = I.run_incremental(table, path, sound, ["k"], "g")
    assert rows(fixed.select("k", "g")) == [(1, "fine"), (2, "ok")]


def test_arrays_slices_and_a_run_that_dies(spark, data, tmp_path):
    questions = fx.questions(spark, data).select("qid", "question")
    path, log = str(tmp_path / "out"), tmp_path / "calls"
    log.mkdir()

    def model():
        def run(prompts, n):
            for p in prompts:
                with open(log / hashlib.sha256(p.encode()).hexdigest(), "a") as file:
                    file.write("x")
            return [[f"{p}-{i}" for i in range(n)] for p in prompts]

        return run

    left = [2]

    def job(todo):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("the cluster went away")
        return answer_questions(todo, model, "math", n=5)

    with pytest.raises(RuntimeError):
        I.run_incremental(questions, path, job, ["qid"], "generation", slices=4)
    kept = I.newest(spark, path, ["qid"], "generation").count()
    assert 0 < kept < questions.count()
    left[0] = 100
    whole = I.run_incremental(questions, path, job, ["qid"], "generation", slices=4)
    assert whole.count() == questions.count() and whole.filter("size(generation) = 5").count() == questions.count()
    texts = questions.select("question").distinct().count()
    calls = [len(f.read_text()) for f in log.iterdir()]
    assert len(calls) == texts and sum(calls) == questions.count()


def test_two_outputs_and_a_plan_that_cannot_be_resumed(spark, tmp_path):
    table = spark.createDataFrame([(1,), (2,)], "k int")
    path = str(tmp_path / "out")

    def half(df):
        return df.select("k", F.lit("a").alias("a"), F.when(F.col("k") == 1, "b").alias("b"))

    I.run_incremental(table, path, half, ["k"], ["a", "b"])
    seen = []

    def other(df):
        seen.extend(r.k for r in df.collect())
        return df.select("k", F.lit("a").alias("a"), F.lit("c").alias("b"))

    assert rows(I.run_incremental(table, path, other, ["k"], ["a", "b"]).select("k", "b")) == [(1, "b"), (2, "c")]
    assert seen == [2]
    with pytest.raises(ValueError, match="texts"):
        I.run_incremental(table, str(tmp_path / "x"), lambda df: df.withColumn("a", F.lit(1)), ["k"], "a")
    assert not (tmp_path / "x").exists()


def test_a_stream_leaves_batch_results_alone_and_asks_no_finished_key(spark, data, tmp_path):
    questions = fx.questions(spark, data).select("qid", "question")
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    I.run_incremental(questions.filter("qid < 500"), path, answer, ["qid"], "g")
    questions.filter("qid < 900").repartition(2).write.parquet(source)
    query = I.stream_incremental(
        spark, source, questions.schema, path, answer, progress, key=["qid"], output="g"
    )
    query.awaitTermination()
    found = I.newest(spark, path, ["qid"], "g")
    assert rows(found.select("qid", "g")) == rows(answer(questions.filter("qid < 900")))
    assert spark.read.parquet(path).count() == found.count()


def test_stream_takes_new_files_after_a_restart(spark, data, tmp_path):
    questions = fx.questions(spark, data).select("qid", "question")
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        query = I.stream_incremental(spark, source, questions.schema, path, answer, progress, max_files=1)
        query.awaitTermination()
        return I.newest(spark, path, ["qid"], "g")

    half = questions.filter("qid < 700")
    half.repartition(3).write.parquet(source)
    assert run().count() == half.count()
    questions.filter("qid >= 700").write.mode("append").parquet(source)
    assert rows(run().select("qid", "g")) == rows(answer(questions))
    assert spark.read.parquet(path).count() == questions.count()


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    from gradeframe.sources.tables import append_results

    path = str(tmp_path / "out")
    for _ in range(2):
        append_results(spark.range(3).select(F.col("id").alias("k"), F.lit("t").alias("g")), path, 7)
    assert spark.read.parquet(path).count() == 3


def test_reward_stream_equals_batch(spark, tmp_path):
    from gradeframe.operators.rollouts import reward_report, with_reward

    table = spark.range(200).select(
        (F.col("id") % 4).alias("step"),
        F.when(F.col("id") % 3 == 0, "SELF_SOLVE").otherwise("DELEGATE").alias("t"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    source = str(tmp_path / "in")
    table.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = I.stream_reward_report(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "t", "y")
    query.awaitTermination()
    got = I.newest_report(spark, str(tmp_path / "out"))
    assert rows(got) == rows(reward_report(with_reward(table, "t", "y")).select(got.columns))


def keyed_stream(spark, tmp_path, schema, job, max_files=1):
    source, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    query = I.stream_incremental(
        spark, source, schema, path, job, progress, max_files=max_files, key=["k"], output="g"
    )
    query.awaitTermination()
    return path


def test_a_key_in_later_files_is_asked_once(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([(i, f"p{i}", 2**62 + i, [f"x{i}"]) for i in range(9)], "k int, p string, n long, a array<string>")
    asked = []

    def job(df):
        asked.append(sorted(r.k for r in df.collect()))
        return df.withColumn("g", F.when(F.col("k") == 4, "Error: x").otherwise(F.concat("p", F.col("n"), F.col("a")[0])))

    for some in ("k < 5", "k >= 3 AND k < 7", "k IN (4, 8) OR k < 2"):
        table.filter(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = []
    original = I.snapshots.read_snapshot
    monkeypatch.setattr(I.snapshots, "read_snapshot", lambda *a: read.append(a) or original(*a))
    path = keyed_stream(spark, tmp_path, table.schema, job)
    assert sorted(sum(asked, [])) == [0, 1, 2, 3, 4, 5, 6, 8] and len(asked) == 3
    assert read == []  # no batch reads what was written before
    # a later start knows what failed: that key is asked again when it comes again, and the others are not
    asked.clear()
    table.filter("k IN (2, 4, 7)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keyed_stream(spark, tmp_path, table.schema, job)
    assert sorted(sum(asked, [])) == [4, 7]
    found = I.newest(spark, path, ["k"], "g")
    assert rows(found.filter("k <> 4").select("k", "g")) == [(i, f"p{i}{2**62 + i}x{i}") for i in range(9) if i != 4]


def test_a_stream_learns_from_batch_runs_between_its_starts(spark, tmp_path):
    table = spark.createDataFrame([(i, "p") for i in range(6)], "k int, p string")
    asked = []

    def job(df):
        asked.extend(r.k for r in df.collect())
        return df.select("k", F.lit("ok").alias("g"))

    table.filter("k < 2").write.parquet(str(tmp_path / "in"))
    path = keyed_stream(spark, tmp_path, table.schema, job)
    I.run_incremental(table.filter("k < 4"), path, job, ["k"], "g")
    I.compact(spark, path, ["k"], "g")
    asked.clear()
    table.write.mode("append").parquet(str(tmp_path / "in"))
    keyed_stream(spark, tmp_path, table.schema, job)
    assert sorted(asked) == [4, 5]
    assert I.newest(spark, path, ["k"], "g").count() == 6


def test_a_batch_that_was_kept_is_not_asked_again(spark, tmp_path):
    import shutil

    table = spark.createDataFrame([(1, "p")], "k int, p string")
    table.write.parquet(str(tmp_path / "in"))
    asked = []

    def job(df):
        asked.append(df.count())
        return df.select("k", F.lit("ok").alias("g"))

    path = keyed_stream(spark, tmp_path, table.schema, job)
    # the stream died after its folder was kept and before it noted the batch as done
    for name in ("0", ".0.crc"):
        shutil.move(tmp_path / "progress" / "commits" / name, tmp_path / f"moved{name}")
    keyed_stream(spark, tmp_path, table.schema, job)
    assert sum(asked) == 1 and I.newest(spark, path, ["k"], "g").count() == 1


def test_keys_are_told_apart_without_python_and_failures_open_one_round_each(spark, tmp_path, capsys):
    from conftest import plan_of

    from gradeframe.streaming import asked as A

    table = spark.createDataFrame([(None, "p"), (1, "p"), (2, "p"), (3, "p")], "k int, p string")
    source, path = str(tmp_path / "in"), str(tmp_path / "out")

    def some(df):
        return df.select("k", F.when(F.col("k") == 1, "Error: x").otherwise("ok").alias("g"))

    I.run_incremental(table.filter("k IS NULL OR k = 1"), path, some, ["k"], "g")
    # a run that died between its two writes tells its outcomes again
    A.record_outcomes(spark, path, ["k"], lambda rows: F.col("g").startswith("Error"))
    for marker in (tmp_path / "out" / "_seen").iterdir():
        marker.rename(tmp_path / marker.name)
    rounds = []
    for _ in range(3):
        asked = []

        def job(df):
            asked.extend(r.k for r in df.collect())
            return df.select("k", F.lit("Error: x" if len(rounds) == 0 else "ok").alias("g"))

        table.write.mode("append").parquet(source)
        keyed_stream(spark, tmp_path, table.schema, job)
        rounds.append(sorted(asked))
    assert rounds == [[1, 2, 3], [1, 2, 3], []]
    known = A.known_keys(table.schema, path, ["k"], spark, str(tmp_path / "known"))
    assert {r.k: (r._good, r._round) for r in known.collect()} == {None: (True, 0), 1: (True, 2), 2: (True, 1), 3: (True, 1)}
    stream = spark.readStream.schema(table.schema).parquet(source)
    plan = plan_of(A.to_ask(stream, known, ["k"]), capsys)
    assert "StreamingDeduplicate" in plan and "Python" not in plan and "TransformWithState" not in plan
