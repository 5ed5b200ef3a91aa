import ast
import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gradeframe.functions.cells import as_attempts, as_list, first_attempt_correct, ingest_cells
from gradeframe.operators.grading import grade_cells


def read(spark, cells, **options):
    table = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    out = ingest_cells(table, "c", **options).withColumn("l", as_list(F.col("value")))
    return [(r["parse_status"], r["l"]) for r in out.orderBy("i").collect()]


def test_known_cells(spark):
    cases = [
        ('["a \\\\boxed{5}"]', "json", ["a \\boxed{5}"]),
        ('["a \\boxed{5}"]', "json_control", ["a \boxed{5}"]),
        ("['x \\\\boxed{5}']", "quoted", ["x \\boxed{5}"]),
        ("['x \\boxed{5}']", "quoted", ["x \boxed{5}"]),
        ('["\\cdot"]', "fallback", ["\\cdot"]),
        ("""['a', "it's"]""", "fallback", ["a", "it's"]),
        ("('a', 'b')", "fallback", ["a", "b"]),
        ("['a',]", "fallback", ["a"]),
        ("[None, True, 'a']", "fallback", [None, "true", "a"]),
        ('"scalar"', "json", ["scalar"]),
        ("42", "json", ["42"]),
        ("[]", "json", []),
        ("nan", "blank", []),
        (" None ", "blank", []),
        ("", "blank", []),
        (None, "blank", []),
        ("null", "json", []),
        ("[1] x", "failed", []),
        ("[1]] x", "failed", []),
        ("[1]} ]", "failed", []),
        ("[1], 2", "fallback", ["[1]", "2"]),
        ("plain words", "failed", []),
        ('["a\nb"]', "failed", []),
        ("['a' 'b']", "fallback", ["ab"]),
        ("['\\x41']", "fallback", ["A"]),
    ]
    assert read(spark, [c[0] for c in cases]) == [c[1:] for c in cases]


def test_long_cells(spark):
    text = "\\\\x 'y' " * 50_000
    cells = [json.dumps([text]), repr([text.replace("'", "")]), repr([text + '"'])]
    assert [status for status, _ in read(spark, cells)] == ["json", "quoted", "fallback"]


def test_without_fallback_no_python_is_planned(spark, capsys):
    from conftest import plan_of

    table = spark.createDataFrame([("[1,]",)], "c string")
    plain = ingest_cells(table, "c", fallback=False)
    assert "Python" not in plan_of(plain.select("parse_status"), capsys)
    assert plain.first()["parse_status"] == "failed"


TEXT = st.text(alphabet="ab'\"\\\n\t{}[],:\u00e9 N", max_size=8)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(TEXT, max_size=4), min_size=1, max_size=40), st.booleans())
def test_written_lists_are_read_back(spark, lists, as_python):
    cells = [repr(x) if as_python else json.dumps(x) for x in lists]
    assert [found for _, found in read(spark, cells)] == lists
    assert as_python is False or all(ast.literal_eval(c) == x for c, x in zip(cells, lists))


def test_attempt_cells(spark):
    cell = '[{"correct_label":"A","generation":["g1","g2"]}, 5, {"generation":"A"}, {"correct_label":"B","generation":[]}]'
    table = spark.createDataFrame([(cell,), ('{"correct_label":"C","generation":"C"}',), ("[]",), ("nan",)], "c string")
    out = ingest_cells(table, "c").select(as_attempts(F.col("value")).alias("a"), first_attempt_correct(F.col("value")).alias("r"))
    got = [([tuple(a) for a in r["a"]], r["r"]) for r in out.collect()]
    assert got == [
        ([("A", "g1"), (None, None), (None, "A"), ("B", None)], 0),
        ([("C", "C")], 1),
        ([], 0),
        ([], 0),
    ]


def test_grading_of_cells(spark):
    vote = '{"correct_label":"A","generation":"%s"}'
    table = spark.createDataFrame(
        [
            (1, "[%s,%s,5]" % (vote % "A", vote % "(A)")),  # two of three
            (2, "[%s,5]" % (vote % "A")),  # one of two is no majority
            (3, vote % "A"),
            (4, "broken ["),
        ],
        "i int, c string",
    )
    out = {r["i"]: (r["is_correct"], r["parse_status"]) for r in grade_cells(table, "c", "science").collect()}
    assert out == {1: (1, "json"), 2: (0, "json"), 3: (1, "json"), 4: (0, "failed")}
    single = {r["i"]: r["is_correct"] for r in grade_cells(table, "c", "science", "single").collect()}
    assert single == {1: 1, 2: 1, 3: 1, 4: 0}
    math = spark.createDataFrame(
        [("['no', '\\\\boxed{7}']", "7"), ('"\\\\boxed{7}"', "8"), ("nan", "nan")], "c string, answer string"
    )
    assert [r["is_correct"] for r in grade_cells(math, "c", "math").collect()] == [1, 0, 0]
    raw = spark.createDataFrame([("so \\boxed{7}", "7")], "c string, answer string")
    assert grade_cells(raw, "c", "math", "single").first()["is_correct"] == 1


def test_words_inside_strings_stay(spark):
    cases = [
        ("{'generation': 'None of these is True', 'ok': true}", '{"generation":"None of these is True","ok":true}'),
        ("""[null, 'true "False"', "it's None", None, false, True, -3]""", '[null,"true \\"False\\"","it\'s None",null,false,true,-3]'),
        ("['a\\'b', 'tab\there', '\\x41\\a\\d', \"\\\\\\\\n\"]", '["a\'b","tab\\there","A\\u0007\\\\d","\\\\\\\\n"]'),
        ("{'a': [1, 2,], 'b': {},}", '{"a":[1,2],"b":{}}'),
    ]
    for fallback in (True, "native"):
        table = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
        out = ingest_cells(table, "c", fallback=fallback).withColumn("j", F.to_json("value")).orderBy("i").collect()
        for r, (cell, expected) in zip(out, cases):
            assert r["parse_status"] in ("quoted", "fallback") and json.loads(r["j"]) == json.loads(expected)


def test_what_no_json_can_write_is_left_to_python_or_fails(spark):
    left = ["('a', 'b')", "['a' 'b']", "[1.50, 'x', None]", "['\\101']", "[1, 'x', 0x1F]", "{1: 'x'}", "[u'x']"]
    bad = ["[,]", "[1 2]", "['a',,]", "[nan, 'x']", "['open", "{'a' 1}", "[1,,]", "{,}", "['a\nb']", "[1 'x']", "[tru e, 'x']"]
    native = read(spark, left + bad, fallback="native")
    assert [status for status, _ in native] == ["failed"] * len(left + bad)
    loose = read(spark, left + bad)
    assert [status for status, _ in loose] == ["fallback"] * len(left) + ["failed"] * len(bad)


def test_native_reading_plans_no_python(spark, capsys):
    from conftest import plan_of

    table = spark.createDataFrame([("[1,]",)], "c string")
    plain = ingest_cells(table, "c", fallback="native")
    assert "Python" not in plan_of(plain.select("value", "parse_status"), capsys)
    assert plain.first()["parse_status"] == "fallback"


LITERAL = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**12), 10**12) | TEXT,
    lambda x: st.lists(x, max_size=3) | st.dictionaries(TEXT, x, max_size=3),
    max_leaves=8,
)


@settings(max_examples=15, deadline=None)
@given(st.lists(LITERAL, min_size=1, max_size=40))
def test_literals_are_read_alike_with_and_without_python(spark, values):
    table = spark.createDataFrame([(i, repr([v])) for i, v in enumerate(values)], "i int, c string")
    for fallback in (True, "native"):
        out = ingest_cells(table, "c", fallback=fallback).withColumn("j", F.to_json("value")).orderBy("i").collect()
        for r, value in zip(out, values):
            assert json.loads(r["j"]) == [value], (r["c"], r["parse_status"])
