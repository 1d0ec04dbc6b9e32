"""Spans that the trees add: hand examples, held-out rewritten texts, numbers that are nobody's."""

import pytest
from pyspark.sql import functions as F

from glint.llm import pii

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return pii.train(docs, train_docs=5000)


def spans(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_spans(df, model).select("doc_id", pii.joined("found").alias("s")).collect()
    return [r["s"] for r in sorted(found, key=lambda r: r["doc_id"])]


def test_written_out_and_national_forms_are_found(spark, model):
    assert spans(spark, model, ["write to john [at] mail [dot] com today", "call (555) 123-4567 now",
                                "Tel 0049 30 1234567 or so", "x.y(at)host(dot)org"]) == [
        "email:9:33", "phone:5:19", "phone:4:19", "email:0:19"]


def test_numbers_that_are_nobodys_stay(spark, model):
    assert spans(spark, model, ["order 812088970 shipped", "from 1999-2004", "on 2024-01-05", "1 234 567 890 people",
                                "version 10 (2003) 12.5", "id 2123465659789240", "a [at] b", None, ""]) == [""] * 9


def test_held_out_rewritten_texts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    used = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(5000)
    rest = docs.join(used, "doc_id", "left_anti").filter("text rlike '[0-9@]'")
    found = pii.rewritable(pii.base_spans(F.col("text")))
    rows = (rest.select("doc_id", "text", found.alias("f")).filter(F.size("f") > 0).withColumn("r", pii.rewritten("text", "f"))
            .select("doc_id", F.col("r.out").alias("text"), F.col("r.got").alias("got")))
    hit = pii.find_spans(rows, model, found="hit").selectExpr("got", "array_except(hit, base) AS extra")
    want, extra, right = hit.selectExpr("sum(size(got))", "sum(size(extra))", "sum(size(array_intersect(got, extra)))").first()
    assert want > 100 and right / want > 0.9 and right / extra > 0.95
    plain = pii.find_spans(docs, model, found="hit").selectExpr("sum(size(hit) - size(base))", "sum(size(base))").first()
    assert plain[0] <= 0.01 * plain[1]


def test_rewriting_keeps_the_rest_and_tells_where(spark):
    text = "a é b.c@host.org and +1 (743) 555-3824, end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = df.withColumn("f", pii.rewritable(pii.base_spans(F.col("text")))).select(pii.rewritten("text", "f").alias("r")).first()["r"]
    assert [k["kind"] for k in r["got"]] == ["email", "phone"]
    pieces = [r["out"][k["s"]:k["e"]] for k in r["got"]]
    assert r["out"] == f"a é {pieces[0]} and {pieces[1]}, end"
    assert "@host" not in pieces[0] or " @ " in pieces[0]
    assert not pieces[1].startswith("+")


def test_no_python_in_the_plan(spark, model):
    from tests.test_plans import plan_of

    df = spark.range(5).selectExpr("id AS doc_id", "concat('x', id) AS text")
    plan = plan_of(pii.redact(df, model))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
