"""Quality scores by a sparse ensemble of rules taken from trees.

Statistics of whole texts are computed as columns once and stored. A random forest is
grown on a bounded sample of labelled rows; every path from a root to a node becomes a
conjunctive rule, and a lasso logistic regression over the rules' indicators keeps the few
that matter. The kept rules are compiled into one Column expression, so that scoring runs
no model code.

Defined cases: a NULL or empty text has all statistics 0 and is scored like any other;
statistics over no words or lines are 0. Labels that are NULL, and labels of unknown
documents, are left out; repeated rows count each. With no labels, or labels of one kind
only, every text gets their smoothed share. Labels are read only for learning. Other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilect.llm.quality_rules import measurements
from trilect.llm.shared import BLANKS, crc_remainder, let, text_of, words_of
from trilect.session import store

#: Labelled rows that are learnt from at most: those whose id has the smallest hashes.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.002

FEATURES = (
    "log_words", "word_length", "symbols", "exclaims", "repeats", "distinct", "dup_lines", "line_words",
    "upper", "digits", "marks", "longest_word",
)

#: A rule: (feature, whether at most, threshold) for each step of its path.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of each row's whole text."""
    t = text_of(text)
    m = F.col("m")
    of_words = let(
        words_of(t),
        lambda w: F.struct(
            F.size(F.array_distinct(w)).alias("distinct"),
            F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).alias("longest"),
        ),
    )
    counted = docs.select(
        F.col(doc_id).alias("doc_id"),
        measurements(t).alias("m"),
        of_words.alias("w"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count(t, F.lit(r"\p{N}")).alias("digits"),
        F.regexp_count(t, F.lit(rf"[^\p{{L}}\p{{M}}\p{{N}}{BLANKS}]")).alias("marks"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, chars = m["n_words"], m["word_chars"]
    values = {
        "log_words": F.log1p(n.cast("double")),
        "word_length": share(chars, n),
        "symbols": share(m["n_symbols"], n),
        "exclaims": share(m["n_exclaims"], n),
        "repeats": share(m["n_repeat_words"], n),
        "distinct": share(F.col("w")["distinct"], n),
        "dup_lines": share(m["n_dup_lines"], m["n_lines"]),
        "line_words": share(n, m["n_lines"]),
        "upper": share(F.col("upper"), chars),
        "digits": share(F.col("digits"), chars),
        "marks": share(F.col("marks"), chars),
        "longest_word": F.col("w")["longest"].cast("double"),
    }
    return counted.select("doc_id", *[values[f].alias(f) for f in FEATURES])


def paths(tree: str, features: tuple[str, ...] = FEATURES) -> list[Rule]:
    """The rules of one tree, from its printed form: one for every node but the root."""
    found, stack = [], []
    for line in tree.splitlines():
        step = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if step:
            depth = len(step[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, (features[int(step[3])], step[4] == "<=", float(step[5]))))
            found.append(tuple(s for _, s in stack))
    return found


def condition(rule: Rule) -> Column:
    """Whether a row satisfies every step of the rule."""
    steps = [F.col(f) <= F.lit(at) if below else F.col(f) > F.lit(at) for f, below, at in rule]
    return reduce(lambda a, b: a & b, steps)


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with their weights."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        terms = [F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Learns from (statistics, label) rows; the result doesn't depend on their order beyond sampling."""
    import math

    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), ())
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird"
    ).fit(assembled)
    rules = sorted({r for t in forest.trees for r in paths(t.toDebugString)})
    if not rules:
        return RuleEnsemble(math.log(ones / (n - ones)), ())
    names = [f"r{k}" for k in range(len(rules))]
    marked = rows.select("label", *[condition(r).cast("double").alias(a) for r, a in zip(rules, names)])
    met = VectorAssembler(inputCols=names, outputCol="x").transform(marked).select("label", "x")
    model = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=80).fit(met)
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients) if w)
    return RuleEnsemble(float(model.intercept), kept)


def sample(stats: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The statistics of at most ``rows`` labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.filter(F.col("label").isNotNull() & (crc_remainder("doc_id", 5) != 0))
    return stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("label", *FEATURES)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    stats = store(statistics(docs))
    model = fit(store(sample(stats, labels, "quality")))
    scored = stats.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
