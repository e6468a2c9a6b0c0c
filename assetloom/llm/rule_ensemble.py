"""Quality classifier as a sparse rule ensemble (operator 6).

Statistics of whole texts are plain column expressions, computed once. A forest of shallow trees is fitted on labelled
statistics; every path from a root to a node becomes a conjunctive rule. A logistic regression with an L1 penalty
weighs the rules and drops most. The rest is compiled into one Spark column expression, so scoring is a projection.

Trees and weights are fitted on about ``sample_rows`` labelled rows at most (all of them, if there are fewer), chosen
by a hash of the id. Defined cases: null, empty and blank texts have zero statistics and are scored like any other;
labels may be booleans, numbers or their text; others than 0 and 1, null ones, and those of unknown documents are ignored; if the labels left are all alike the score is that label
smoothed towards one half, and 0.5 without any; repeated rows are scored alike, repeated labels count twice; an empty
table gives an empty result; null ids are scored but never learnt from; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from assetloom.common import materialize
from assetloom.llm.langid import held_out
from assetloom.llm.rows import sample_of
from assetloom.llm.text import SYMBOLS, count_chars, lines_of, n_letters, n_upper, ratio, words_of

Condition = tuple[int, str, float]
STATISTICS = [
    *("n_words", "mean_word", "symbol_ratio", "bar_ratio", "bang_ratio", "upper_ratio", "digit_ratio"),
    *("dup_line_ratio", "words_per_line", "distinct_ratio", "stop_ratio"),
]


def text_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, statistics...) of every whole text."""
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t, text = t.withColumn("w", words_of(F.col("t"))).withColumn("lines", lines_of(F.col("t"))), F.col("t")
    n, chars, lines = F.size("w"), F.length(F.array_join("w", "")), F.size("lines")
    return t.select(
        "id",
        n.cast("double").alias("n_words"),
        ratio(chars, n).alias("mean_word"),
        ratio(count_chars(text, SYMBOLS), chars).alias("symbol_ratio"),
        ratio(count_chars(text, "|"), n).alias("bar_ratio"),
        ratio(count_chars(text, "!"), n).alias("bang_ratio"),
        ratio(n_upper(text), n_letters(text)).alias("upper_ratio"),
        ratio(count_chars(text, "0123456789"), chars).alias("digit_ratio"),
        ratio(lines - F.size(F.array_distinct("lines")), lines).alias("dup_line_ratio"),
        ratio(n, lines).alias("words_per_line"),
        ratio(F.size(F.array_distinct("w")), n).alias("distinct_ratio"),
        ratio(F.size(F.filter("w", lambda w: F.length(w) <= 3)), n).alias("stop_ratio"),
    )


def rules_of(debug: str) -> list[tuple[Condition, ...]]:
    """The paths of all trees in a model's description: each a set of conditions (feature, comparison, threshold)."""
    found: dict[tuple[Condition, ...], None] = {}
    path: list[tuple[int, Condition]] = []
    for line in debug.splitlines():
        m = re.match(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if re.match(r"^\s*Tree ", line):
                path = []
            continue
        depth = len(m[1])
        path = [(d, c) for d, c in path if d < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
        found.setdefault(tuple(sorted({c for _, c in path})))
    return list(found)


def rule_column(rule: tuple[Condition, ...], columns: list[str]) -> Column:
    """1.0 where all conditions of a rule hold, else 0.0."""
    holds = [F.col(columns[f]) <= v if op == "<=" else F.col(columns[f]) > v for f, op, v in rule]
    return F.when(reduce(lambda a, b: a & b, holds), 1.0).otherwise(0.0)


def fit_rules(labelled: DataFrame, columns: list[str], label: str, trees: int, depth: int, penalty: float, seed: int = 7) -> tuple[float, list[tuple[float, tuple[Condition, ...]]]]:
    """(intercept, [(weight, rule)]) of the rules that the lasso keeps. ``labelled`` is bounded."""
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    if len(counts) < 2:
        n, positive = sum(counts.values()), counts.get(1, 0)
        p = (positive + 1) / (n + 2)
        return math.log(p / (1 - p)), []
    # One partition in a fixed order, so that reruns draw the same trees.
    rows = labelled.coalesce(1).sortWithinPartitions("id")
    vectors = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep").transform(rows)
    forest = RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=max(1, sum(counts.values()) // 500)).fit(vectors)
    rules = rules_of(forest.toDebugString)
    if not rules:
        p = counts.get(1, 0) / sum(counts.values())
        return math.log(p / (1 - p)), []
    names = [f"__r{k}" for k in range(len(rules))]
    fired = rows.select(F.col(label), *[rule_column(r, columns).alias(x) for r, x in zip(rules, names)])
    lasso = LogisticRegression(featuresCol="__x", labelCol=label, elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(VectorAssembler(inputCols=names, outputCol="__x").transform(fired))
    return float(lasso.intercept), [(float(w), r) for w, r in zip(lasso.coefficients, rules) if abs(w) > 1e-6]


def score_column(intercept: float, rules: list[tuple[float, tuple[Condition, ...]]], columns: list[str]) -> Column:
    """The compiled ensemble: a probability between 0 and 1."""
    total = reduce(lambda a, r: a + F.lit(r[0]) * rule_column(r[1], columns), rules, F.lit(intercept))
    return 1.0 / (1.0 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, trees: int = 16, depth: int = 3, penalty: float = 0.001, folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per document: id, held_out, score, predicted. Learns from labels whose id isn't held out."""
    stats = materialize(text_statistics(docs, id_col, text_col), "rule-stats")
    label = F.col(label_col).try_cast("double")
    known = F.col(id_col).isNotNull() & label.isin(0.0, 1.0) & ~held_out(F.col(id_col), folds, fold)
    usable = labels.where(known).select(F.col(id_col).alias("id"), label.cast("int").alias("label"))
    sample = usable.where(sample_of(F.col("id"), sample_rows / max(1, usable.count())))
    labelled = materialize(sample.join(stats, "id"), "rule-sample")
    intercept, rules = fit_rules(labelled, STATISTICS, "label", trees, depth, penalty)
    scored = stats.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), score_column(intercept, rules, STATISTICS).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
