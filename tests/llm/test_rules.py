"""The compiled rule ensemble against plain statistics and plain rules."""

import math

import pytest

import brute as B
from assetloom.common import load, materialize
from assetloom.llm import rule_ensemble
from assetloom.llm.langid import held_out
from pyspark.sql import functions as F


def statistics(text):
    w, t = B.words(text), text or ""
    lines = [x for x in t.split("\n") if B.words(x)]
    chars, letters = sum(map(len, w)), len(B.regex.findall(r"\p{L}", t))
    part = lambda a, b: a / b if b else 0.0
    count = lambda signs: sum(c in signs for c in t)
    return [
        len(w), part(chars, len(w)), part(count("#*$%&|<>"), chars), part(count("|"), len(w)), part(count("!"), len(w)), part(len(B.regex.findall(r"\p{Lu}", t)), letters), part(count("0123456789"), chars),
        part(len(lines) - len(set(lines)), len(lines)), part(len(w), len(lines)), part(len(set(w)), len(w)), part(sum(len(x) <= 3 for x in w), len(w)),
    ]


def test_scores(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    stats = {r.id: list(r)[1:] for r in rule_ensemble.text_statistics(docs, "doc_id", "text").collect()}
    for r in docs.collect():
        assert stats[r.doc_id] == pytest.approx(statistics(r.text), rel=1e-12), r.doc_id
    # The fit again, on its own: its rules are then applied by hand.
    usable = labels.where(~held_out(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    table = materialize(rule_ensemble.text_statistics(docs, "doc_id", "text").join(usable, "id"), "test-rules")
    intercept, rules = rule_ensemble.fit_rules(table, rule_ensemble.STATISTICS, "label", 16, 3, 0.001)
    assert 0 < len(rules) < 200
    for r in rule_ensemble.score_quality(docs, labels).collect():
        x = stats[r.doc_id]
        total = intercept + sum(w for w, rule in rules if all(x[f] <= v if op == "<=" else x[f] > v for f, op, v in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and r.predicted == int(r.score >= 0.5)


def test_stated_rules(spark):
    """A rule column fires exactly where its conditions hold."""
    df = spark.createDataFrame([(k, k / 10.0, (k * 7 % 10) / 10.0) for k in range(10)], "id long, a double, b double")
    rule = ((0, "<=", 0.5), (1, ">", 0.3))
    got = {r.id: r.f for r in df.select("id", rule_ensemble.rule_column(rule, ["a", "b"]).alias("f")).collect()}
    assert got == {k: float(k / 10 <= 0.5 and (k * 7 % 10) / 10 > 0.3) for k in range(10)}


def test_kinds_of_labels(spark, sf_dir):
    """Booleans and text are labels like numbers."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select("doc_id", "quality")
    score = lambda c: {r.doc_id: r.score for r in rule_ensemble.score_quality(docs, labels.withColumn("quality", c)).collect()}
    assert score(F.col("quality")) == score(F.col("quality").cast("boolean")) == score(F.col("quality").cast("string"))
    odd = F.when(F.col("doc_id") % 2 == 0, F.col("quality").cast("string")).otherwise("good")
    assert len(score(odd)) == docs.count()
