"""Scalar text functions, detection backends and their failure isolation."""

import pytest
from pyspark.sql import functions as F

from snippetflow.functions import text as X
from snippetflow.functions.cues import CODE_CUE_TABLE, CODE_LANGUAGES, TEXT_CUE_TABLE
from snippetflow.operators import detect, profile


def one(spark, col, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_response_clean(spark):
    got = one(spark, X.clean_response("x"), [("' Python '",), ('\n"C++"\t',), ("",), ("　Go\x1f",)])
    assert got == [" Python ", "C++", "", "Go"]


def test_crops(spark):
    assert one(spark, X.crop_head("x", 3), [("abcdefgh",), ("abc",)]) == ["abc", "abc"]
    assert one(spark, X.crop_tail("x", 3), [("abcdefgh",), ("abc",)]) == ["fgh", "abc"]
    df = spark.range(200).select(F.col("id"), F.lit("abcdefgh").alias("code"))
    starts = {r[0] for r in df.select(X.crop_start("code", 3, 42, "id")).collect()}
    assert starts == set(range(6))
    w = df.select(X.crop_window("code", 3, 42, ("id",)).alias("w"), X.crop_start("code", 3, 42, "id").alias("s"))
    assert all(r["w"] == "abcdefgh"[r["s"]:r["s"] + 3] for r in w.collect())
    assert one(spark, X.crop_window("x", 3), [(7, "abc")], "id long, x string") == ["abc"]
    ch = [r[0] for r in df.select(X.crop_choice(42, ("id",))).collect()]
    assert set(ch) == {"head", "tail", "middle"}


def test_format_duration(spark):
    got = one(spark, X.format_duration("x"), [(3661.0,), (3600.0,), (60.0,), (59.9,)], "x double")
    assert got == ["1h 1m 1s", "1h 0m 0s", "1m 0s", "59s"]


def test_tokens_truncated(spark):
    txt = " ".join(f"W{i}" for i in range(600))
    got = spark.createDataFrame([(txt,)], "x string").select(X.tokens_truncated("x", 512).alias("t")).first()["t"]
    assert len(got) == 512 and got[0] == "w0"


def test_prompt(spark):
    p = spark.createDataFrame([("x" * 3000,)], "code string").select(X.chat_prompt(CODE_LANGUAGES).alias("p")).first()["p"]
    assert [t["role"] for t in p] == ["system", "user"]
    assert "['JavaScript', 'PHP', 'Java', 'Python', 'C#', 'C++', 'Go', 'C']" in p[0]["content"]
    assert p[1]["content"] == "Code snippet:\n\n" + "x" * 2048 + "\n\nIdentify the language:"


def test_demo_snippets(spark):
    """The three demo snippets: Python, Java and C++ by the code cue table."""
    rows = [(1, 'def hello_world():\n    print("Hello, World!")\n    return True\n'),
            (2, 'public class HelloWorld {\n    public static void main(String[] args) {\n'
                '        System.out.println("Hello, World!");\n    }\n}\n'),
            (3, '#include <iostream>\nusing namespace std;\n\nint main() {\n'
                '    cout << "Hello, World!" << endl;\n    return 0;\n}\n')]
    df = spark.createDataFrame(rows, "id long, code string")
    got = {r["id"]: r["detected_language"] for r in detect.detect_language(df, CODE_CUE_TABLE).collect()}
    assert got == {1: "Python", 2: "Java", 3: "C++"}


def test_text_cues_ties_and_unknown(spark):
    df = spark.createDataFrame([(1, "der the"), (2, "xyz"), (3, None), (4, "le le the")], "id long, code string")
    got = {r["id"]: r["detected_language"] for r in detect.detect_language(df, TEXT_CUE_TABLE).collect()}
    assert got == {1: "de", 2: "Unknown", 3: "Unknown", 4: "fr"}
    idx = {r["id"]: r["p"] for r in TEXT_CUE_TABLE.apply(df, "code", "p", "index").collect()}
    assert idx == {1: 0, 2: 0, 3: 0, 4: 3}


def _failing_model():
    def predict(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("backend failure")
        return [" 'Python' " if "def" in t else "Go" for t in texts]
    return predict


def test_batch_model_isolates_failures(spark):
    rows = [(1, "def f(): pass"), (2, "boom"), (3, None), (4, "package main")]
    df = spark.createDataFrame(rows, "id long, code string")
    got = {r["id"]: r["detected_language"]
           for r in detect.detect_language(df, detect.BatchModel(_failing_model, batch_size=4)).collect()}
    assert got == {1: "Python", 2: "Unknown", 3: "Unknown", 4: "Go"}


def test_plug_in_column_backend(spark):
    df = spark.createDataFrame([(1, "x")], "id long, code string")
    out = detect.detect_language(df, lambda c: F.upper(c)).first()["detected_language"]
    assert out == "X"


def test_cue_detection_has_no_python(spark):
    df = spark.createDataFrame([(1, "the")], "id long, code string")
    plan = detect.detect_language(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([("abc",)] * 5, "code string")
    h = profile.length_histogram(df).collect()
    assert len(h) == 50 and sum(r["n"] for r in h) == 5
    assert [r["bin"] for r in h if r["n"]] == [25]


def test_running_average(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 3.0, 3)], "k int, o int, v double, n int")
    got = [r["running_avg"] for r in profile.running_average(df, "k", "o", "v", "n").orderBy("o").collect()]
    assert got == [1.0, 2.5]
    b = profile.running_average(df, "k", "o", "v", "n", bucket=F.col("o")).orderBy("o").collect()
    assert [r["running_avg"] for r in b] == [1.0, 2.5]
