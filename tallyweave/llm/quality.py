"""Quality by a sparse ensemble of rules.

Statistics of each text are column expressions. On a bounded sample of labelled rows a random forest of shallow
trees is grown; every path from a root is a conjunctive rule over the statistics. A logistic regression with
an L1 penalty weighs the rules and drops most of them. The rest is compiled to one column expression, so that
texts are scored without Python.

Defined results: a null text counts as empty, and all its statistics are 0; labels that are null, and ids
without label or document, do not take part; of several labels of one id the largest counts; without labelled
rows of both kinds every text gets the share of label 1 (0 if there is none); null ids and repeated rows are
scored like others; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.labels import SAMPLE_ROWS, labelled_sample
from tallyweave.session import settle

TREES = 24
DEPTH = 3
PENALTY = 0.002
ITERATIONS = 60
SEED = 11

#: A condition is (statistic, is upper bound, bound); a rule is a sequence of them, all of which must hold.
Condition = tuple[str, bool, float]


def statistics(text: Column) -> list[Column]:
    """The named statistics of a text."""
    text = F.coalesce(text, F.lit(""))
    # split leaves an empty string at either end of a text that begins or ends with white space
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.split(text, "\n")
    chars, count = F.length(text), F.size(words)

    def share(pattern: str) -> Column:
        return F.coalesce(F.regexp_count(text, F.lit(pattern)) / F.nullif(chars, F.lit(0)), F.lit(0.0))

    return [
        F.log1p(chars.cast("double")).alias("log_chars"),
        F.log1p(count.cast("double")).alias("log_words"),
        F.coalesce(chars / F.nullif(count, F.lit(0)), F.lit(0.0)).alias("word_length"),
        F.coalesce(F.size(F.array_distinct(words)) / F.nullif(count, F.lit(0)), F.lit(0.0)).alias("distinct_words"),
        F.coalesce(F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0)).alias("distinct_lines"),
        F.coalesce(F.size(lines) / F.nullif(chars, F.lit(0)), F.lit(0.0)).alias("lines"),
        share(r"\p{Lu}").alias("upper"),
        share(r"[0-9]").alias("digits"),
        share(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'-]").alias("symbols"),
        share(r"[.,;:]").alias("points"),
        share(r"[|{}<>\\=_/]").alias("marks"),
        share(r"!").alias("shouts"),
    ]


STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "distinct_lines", "lines", "upper", "digits", "symbols", "points", "marks", "shouts",
)


def paths(debug: str, names=STATISTICS) -> list[tuple[Condition, ...]]:
    """Every path from a root, to inner nodes too, of trees as Spark ML describes them."""
    found, open_ = [], []
    for line in debug.splitlines():
        match = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if match:
            depth = len(match[1])
            open_ = [x for x in open_ if x[0] < depth]
            open_.append((depth, (names[int(match[3])], match[4] == "<=", float(match[5]))))
            found.append(tuple(c for _, c in open_))
        elif line.lstrip().startswith("Tree"):
            open_ = []
    return found


def simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The same rule with one bound per statistic and side."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, upper, bound in rule:
        held = bounds.get((name, upper), bound)
        bounds[name, upper] = min(held, bound) if upper else max(held, bound)
    return tuple(sorted((name, upper, bound) for (name, upper), bound in bounds.items()))


def holds(rule: tuple[Condition, ...]) -> Column:
    """The rule as a condition on the columns of the statistics."""
    return reduce(lambda a, b: a & b, [F.col(n) <= b if upper else F.col(n) > b for n, upper, b in rule])


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def probability(self) -> Column:
        """Probability of label 1 from the columns of the statistics."""
        margin = F.lit(float(self.bias))
        for rule, weight in self.rules:
            margin = margin + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, training: Column, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """An ensemble fitted to the labelled rows of ``docs`` that ``training``, a condition on doc_id, admits."""
    # the sample is bounded, hence so is what is broadcast
    sample = F.broadcast(labelled_sample(labels, label_col, training, SAMPLE_ROWS))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id")
    rows = settle(texts.select(F.col("label").cast("double").alias("label"), *statistics(F.col("text"))), "statistics")
    total, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < total:
        share = ones / total if total else 0.0
        return Ensemble({0.0: -1e3, 1.0: 1e3}[share], ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=3, featureSubsetStrategy="onethird", seed=SEED)
    rules = sorted({simplified(r) for r in paths(forest.fit(vectors).toDebugString)})
    if not rules:  # nothing tells the labels apart
        return Ensemble(log(ones / (total - ones)), ())
    flagged = rows.select("label", *[holds(r).cast("double").alias(f"rule{i}") for i, r in enumerate(rules)])
    flagged = settle(VectorAssembler(inputCols=[f"rule{i}" for i in range(len(rules))], outputCol="features").transform(flagged).select("label", "features"), "rules")
    # Spark's own scaling would favour rare rules; the flags are alike in scale already
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=ITERATIONS, standardization=False)
    model = lasso.fit(flagged)
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-9)
    return Ensemble(float(model.intercept), kept)


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    measured = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.struct(*statistics(F.col(text_col))))).alias("s"))
    # the one-row explode keeps the optimiser from writing a statistic out once for each rule that uses it
    return measured.select("doc_id", "s.*").select("doc_id", model.probability().alias("score"))
