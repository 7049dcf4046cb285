"""Sinks, articles and fallback rules."""
from pyspark.sql import functions as F

from cohortvox.plans import exports as X, summary as S


def test_articles(spark):
    rows = [("/kb/a.md", "TITLE: One\nKEYWORDS: k, l\nVERSION: 2\n---\nBody --- text\n"), ("/kb/b.md", "only body"), ("/kb/c", "")]
    got = {r.id: r for r in X.articles(spark.createDataFrame(rows, "path string, value string")).collect()}
    assert got["a"].document_text == "Title: One\n\nKeywords: k, l\n\nBody --- text" and got["a"].version == "2"
    assert got["b"].document_text == "only body" and got["b"].title == "" and got["c"].body == ""


def test_fallback(spark):
    df = spark.createDataFrame([("edema_degree", ["x"], 14.9, "left", 1), ("hemisphere", ["x"], 0.0, None, 1), ("distribution", ["x"], 0.0, None, 2), ("other", ["p", "q"], 0.0, None, 1), ("other", [], 0.0, None, 1)], "f string, a array<string>, e double, h string, n int").coalesce(1)
    got = [r.v for r in df.select(X.fallback_value(F.col("f"), F.col("a"), F.col("e"), F.col("h"), F.col("n")).alias("v")).collect()]
    assert got == ["Moderate", "x", "multifocal", "p", ""]


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "one"), (2, "two")], "case_id int, text string")
    X.write_text(df, f"{tmp_path}/t")
    assert {(r.case_id, r.value) for r in spark.read.text(f"{tmp_path}/t").collect()} == {(1, "one"), (2, "two")}
    X.save_vectors(spark.createDataFrame([("a", [1.0]), ("a", [1.0])], "id string, v array<double>"), f"{tmp_path}/v")
    assert X.load_vectors(spark, f"{tmp_path}/v").count() == 1
    s = spark.createDataFrame([(1, "x")], "case_id int, note string")
    S.write_json(s, f"{tmp_path}/j")
    assert S.read_json(spark, f"{tmp_path}/j", s).collect() == s.collect()
    assert X.without_summary(df, s).first().case_id == 2


def test_printed_scores(spark):
    t = spark.createDataFrame([("Label 1\n  Dice Score: 0.5 (50.00%)\nMean Dice Score (WT, TC, ET): 0.8705 (87.05%)",), ("none",)], "t string").coalesce(1)
    assert [r.v for r in t.select(X.parse_mean_dice(F.col("t")).alias("v")).collect()] == [87.05, None]


def test_laterality(spark):
    a = spark.createDataFrame([(1, "left"), (2, "right-predominant"), (3, "bilateral"), (4, "left")], "case_id int, hemisphere string")
    b = spark.createDataFrame([(1, "left"), (2, "right"), (3, "left"), (4, "right")], "case_id int, tumor_hemisphere string")
    assert {r.case_id: r.consistent for r in S.laterality_check(a, b).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_article_files_come_in_order(spark, tmp_path):
    import os

    for name in ("b/2.md", "a/10.md", "a/9.md", "a/skip.txt"):
        os.makedirs(f"{tmp_path}/{os.path.dirname(name)}", exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(f"TITLE: {name}\n---\nbody\nof two lines")
    files = X.article_files(spark, f"file://{tmp_path}")
    assert [r.path.split("/")[-1] for r in files.collect()] == ["10.md", "9.md", "2.md"]
    assert {(r.id, r.title, r.body) for r in X.articles(files).collect()} == {("10", "a/10.md", "body\nof two lines"), ("9", "a/9.md", "body\nof two lines"), ("2", "b/2.md", "body\nof two lines")}


def test_output_folder(spark):
    from cohortvox.streaming import stages as T

    jobs = spark.createDataFrame([("j1", "c1", "/given"), ("j2", "c1", None), ("j3", "c9", None)], "job_id string, case_id string, folder string")
    outputs = spark.createDataFrame([("c1", "/out/b"), ("c1", "/out/a")], "case_id string, folder string")
    assert {r.job_id: r.folder for r in T.output_folder(jobs, outputs).collect()} == {"j1": "/given", "j2": "/out/a", "j3": None}
