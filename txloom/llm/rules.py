"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled rows; every path from
a root to a node is a conjunctive rule over the statistics.  A logistic
regression with an L1 penalty weighs the rules, most weights become zero, and
what is left is compiled into one Spark column expression.  Scoring is then a
projection: it needs neither the trees nor a model object.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .stats import document_measures

#: Most labelled rows that a fit reads: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
ACCEPT = 0.7
TREES, DEPTH, SEED = 16, 3, 7
PENALTY = 2e-3

#: Statistics as expressions over the measurements; none reads labels, lang, source or doc_id.
STATISTICS = {
    "words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "brackets": "n_brackets / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(n_upper + n_lower, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "wide": "n_wide / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct_words / greatest(n_words, 1)",
    "short_words": "n_short_words / greatest(n_words, 1)",
    "long_words": "n_long_words / greatest(n_words, 1)",
    "top_word": "top_word / greatest(n_words, 1)",
    "line_words": "ln(1 + n_words / greatest(n_lines, 1))",
}


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions; a condition is (statistic, "<=" or ">", threshold)."""
    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, str, float], ...]], ...]

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        margin = F.lit(self.intercept)
        for weight, conditions in self.rules:
            margin = margin + F.when(conjunction(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def conjunction(conditions) -> Column:
    test = F.lit(True)
    for name, sign, limit in conditions:
        test = test & (F.col(name) <= limit if sign == "<=" else F.col(name) > limit)
    return test


def tree_paths(printed: str, names: list[str]) -> list[tuple]:
    """Every path from a root to a node of a printed tree ensemble, as conditions without repeats."""
    line = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)$")
    paths, stack = {}, []
    for text in printed.splitlines():
        found = line.match(text)
        if not found:
            if text.lstrip().startswith("Tree"):
                stack = []
            continue
        depth = len(found[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (names[int(found[2])], found[3], float(found[4]))))
        paths[_tightest([c for _, c in stack])] = None
    return list(paths)


def _tightest(conditions: list) -> tuple:
    limits: dict = {}
    for name, sign, limit in conditions:
        held = limits.get((name, sign))
        limits[name, sign] = limit if held is None else (min if sign == "<=" else max)(held, limit)
    return tuple(sorted((name, sign, limit) for (name, sign), limit in limits.items()))


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    measured = document_measures(docs, keep)
    return measured.select(*keep, *[F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items()])


def labelled_sample(labels: DataFrame, target: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``limit`` ids with a label 0 or 1; of an id with both labels the smaller counts."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.min(target).cast("double").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_rules(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Fit on rows with ``label`` and the statistics.

    Without rows the score is 0.5, with one label alone it is that label's
    smoothed share: (n1 + 1) / (n + 2).
    """
    counts = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    if counts.n == 0 or counts.ones in (0, counts.n):
        share = (counts.ones + 1) / (counts.n + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    names = list(STATISTICS)
    table = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=max(1, int(counts.n // 500))).fit(table)
    paths = tree_paths(forest.toDebugString, names)
    if not paths:
        share = (counts.ones + 1) / (counts.n + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    inputs = [f"r{i}" for i in range(len(paths))]
    fired = sample.select("label", *[conjunction(p).cast("double").alias(n) for p, n in zip(paths, inputs)])
    matrix = VectorAssembler(inputCols=inputs, outputCol="features").transform(fired).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(matrix)
    weighed = [(float(w), p) for w, p in zip(lasso.coefficients.toArray(), paths) if abs(w) > 1e-9]
    return RuleModel(float(lasso.intercept), tuple(weighed))


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = SAMPLE_ROWS,
             keep: list[str] | None = None) -> tuple[DataFrame, RuleModel]:
    """(rows of ``docs`` with ``held_out``, ``score``, ``predicted``, and the model).

    Labels are learnt only from ids whose crc32 (of the id as text) mod 4 is not
    2; the rest is held out.  A null text is empty and scored like one; a null
    id is held out.  ``keep`` are the columns to carry along (all, if None).
    Only the texts of the sample are measured for the fit.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    chosen = F.broadcast(labelled_sample(labels.where(~held), target, limit))  # at most ``limit`` narrow rows
    rows = statistics(docs.select("doc_id", "text").join(chosen, "doc_id"), ["doc_id", "label"])
    sample = settle(rows.repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id", *STATISTICS), "sample")
    model = fit_rules(sample)
    keep = docs.columns if keep is None else keep
    inner = [f"_c{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner)], F.col("doc_id").alias("_id"), "text")
    scored = statistics(source, [*inner, "_id"]).withColumn("_score", model.score())
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string")) % 4 == 2, F.lit(True))
    return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, inner)], held_out.alias("held_out"),
                         F.col("_score").alias("score"), (F.col("_score") >= ACCEPT).cast("int").alias("predicted")), model


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    inner = [f"_d{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    named = docs.toDF(*inner).withColumns({"doc_id": F.col(inner[lower.index("doc_id")]), "text": F.col(inner[lower.index("text")])})
    scored, _ = classify(named, labels, keep=inner)
    return scored.where("predicted = 1").select(*inner).toDF(*docs.columns)
