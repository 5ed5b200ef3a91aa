import json

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from gradeframe import schemas as C
from gradeframe.session import fresh_path, shared_dir
from gradeframe.sources import tables as S

SCHEMA = StructType(
    [
        StructField("question", StringType()),
        StructField("decision", IntegerType()),
        StructField("seconds", DoubleType()),
        StructField("generation", ArrayType(StringType())),
    ]
)


def test_pandas_files_are_read(spark, tmp_path):
    frame = pd.DataFrame(
        {
            "extra": [1, 2, 3],
            "generation": [json.dumps(["a", 'say "x"', "l1\nl2", "\\boxed{5}"]), None, "[]"],
            "decision": [1, None, -1],
            "question": ['multi\nline, "quoted"', "é", "033"],
            "seconds": [0.5, None, 2],
        }
    )
    path = str(tmp_path / "t.csv")
    frame.to_csv(path, index=False)
    got = S.read_table(spark, path, SCHEMA)
    assert got.columns == [*SCHEMA.names, "extra"]
    assert rows(got.drop("extra")) == sorted(
        [
            ('multi\nline, "quoted"', 1, 0.5, ["a", 'say "x"', "l1\nl2", "\\boxed{5}"]),
            ("é", None, None, None),
            ("033", -1, 2.0, []),
        ],
        key=repr,
    )
    with pytest.raises(ValueError):
        S.read_table(spark, path, StructType([StructField("absent", StringType())]))
    with pytest.raises(ValueError):
        S.read_table(spark, path)


def test_spark_files_are_read_by_pandas(spark, tmp_path):
    table = spark.createDataFrame([('a "b"\nc\\d', 1, 0.5, ["x", '"']), (None, None, None, None)], SCHEMA)
    path = str(tmp_path / "out")
    S.write_table(table.coalesce(1), path, "csv")
    assert rows(S.read_csv(spark, path, SCHEMA)) == rows(table)
    part = next((tmp_path / "out").glob("*.csv"))
    frame = pd.read_csv(part)
    assert frame.loc[0, "question"] == 'a "b"\nc\\d' and json.loads(frame.loc[0, "generation"]) == ["x", '"']


def test_runs_splits_and_training_sets(spark, tmp_path):
    table = spark.createDataFrame([("q1", "train"), ("q2", "test")], "question string, split string")
    S.write_splits(table, str(tmp_path / "set"))
    assert rows(S.read_table(spark, str(tmp_path / "set")).select("question", "split")) == rows(table)
    assert S.read_table(spark, str(tmp_path / "set/split=train")).count() == 1
    for model in ("m1", "m2"):
        S.write_table(table, str(tmp_path / "runs" / model / "graded"))
    runs = S.read_runs(spark, str(tmp_path / "runs/{model}/graded"), ["m1", "m2"])
    assert rows(runs.groupBy("model").count()) == [("m1", 2), ("m2", 2)]
    with pytest.raises(ValueError):
        S.read_runs(spark, "/no/place", ["m1"])
    assert S.read_training(spark, str(tmp_path / "set")).count() == 2
    csv = str(tmp_path / "t.csv")
    pd.DataFrame({"question": ["a"], "split": ["x"]}).to_csv(csv, index=False)
    assert rows(S.read_training(spark, csv, table.schema)) == [("a", "x")]
    table.createOrReplaceTempView("some_training_set")
    assert S.read_training(spark, "some_training_set").count() == 2


def test_question_mapping(spark, tmp_path):
    path = str(tmp_path / "raw.csv")
    pd.DataFrame({"problem": ["p\n1"], "solution": ["s"], "Year": [1999]}).to_csv(path, index=False)
    got = S.read_questions(spark, path, {"question": "problem", "answer": "solution"}, "AIME", "csv", keep=["Year"])
    assert rows(got.select("question", "answer", "source")) == [("p\n1", "s", "AIME")]
    assert got.filter(F.col("Year").cast("int") <= 2021).count() == 1


def test_results_folder(spark, tmp_path):
    path = str(tmp_path / "results")
    assert S.read_results(spark, path) is None
    S.append_results(spark.range(3), path, 0)
    S.append_results(spark.range(5), path, 1)
    S.append_results(spark.range(4), path, 1)
    assert rows(S.read_results(spark, path).groupBy("run").count()) == [(0, 3), (1, 4)]


def test_schema_helpers(spark):
    table = spark.createDataFrame([("q",)], "question string")
    assert C.require_columns(table, ["question"]) is table
    with pytest.raises(ValueError, match="answer"):
        C.require_columns(table, ["question", "answer"])
    assert C.ensure_column(table, "question") is table
    assert C.ensure_column(table, "n", "int").dtypes[-1] == ("n", "int")
    spark.createDataFrame([], C.GRADED_MCQ)
    spark.createDataFrame([], C.TRAIN_PAIRS)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_csv_keeps_every_text(spark, tmp_path):
    texts = [
        " lead and trail ", "tail\n", "\n", "", None, " ", "\t", "\r", "a\rb", "a\r\nb", '"', 'say "x"', "\\", "end\\",
        '\\"', ",", "#", "null", "é\u2028x", "a,b\n\"c\"",
    ]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, z string")
    path = str(tmp_path / "t.csv")
    S.write_table(table.coalesce(1), path, "csv")
    back = S.read_table(spark, path, table.schema, "csv")
    assert rows(back) == rows(table)
    import glob

    import pandas as pd

    (file,) = glob.glob(f"{path}/*.csv")
    frame = pd.read_csv(file, keep_default_na=False, lineterminator="\n").sort_values("i")
    assert frame["t"].tolist() == [t or "" for t in texts]
