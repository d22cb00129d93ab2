"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees fitted to labelled rows give paths; each path is a conjunctive rule.  A
logistic model with an L1 penalty gives most rules no weight, and the rest become
one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.chunks import turn
from textloom.session import free_name, ship, written

STATS = (
    "log_chars", "log_words", "mean_word", "longest_word", "letters", "upper", "digits", "spaces", "stops", "marks", "symbols", "pipes", "bangs", "non_ascii",
    "lines_per_word", "same_lines", "distinct_words", "top_word", "short_words", "upper_words", "marked_words", "same_pairs", "echoed_words", "sentence_words",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" \t\n\r", "stops": b".?;:", "marks": b",'\"()-",
    "symbols": b"#$%&*+/<=>@[\\]^_`{}~", "pipes": b"|", "bangs": b"!", "non_ascii": bytes(range(128, 256)),
}
_WEIGHTS = np.zeros((256, len(_CLASSES)))
for _j, _chars in enumerate(_CLASSES.values()):
    _WEIGHTS[list(_chars), _j] = 1
_LOWER = np.zeros(256)
_LOWER[97:123] = 1


def text_stats(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text; null counts as empty, where all are 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return (0.0,) * len(STATS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = dict(zip(_CLASSES, counts @ _WEIGHTS / len(data)))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    lengths = [len(w) for w in words] or [0]
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(words) - 1
    out = share | {
        "log_chars": np.log1p(len(data)), "log_words": np.log1p(len(words)), "mean_word": sum(lengths) / n, "longest_word": max(lengths),
        "letters": float(counts @ _LOWER / len(data)) + share["upper"], "lines_per_word": len(lines) / n, "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "distinct_words": len(seen) / n, "top_word": max(seen.values(), default=0) / n, "short_words": sum(x <= 3 for x in lengths) / n,
        "upper_words": sum(w.isupper() for w in words) / n, "marked_words": sum(not w[-1].isalnum() for w in words) / n,
        "echoed_words": sum(map(str.__eq__, words, words[1:])) / n,
        "same_pairs": 1 - len(set(zip(words, words[1:]))) / pairs if pairs > 0 else 0.0, "sentence_words": min(200.0, n / max(1, int(counts[[46, 63, 33]].sum()))),
    }
    return tuple(float(out[k]) for k in STATS)


def with_stats(df: DataFrame, *, text: str = "text", into: str = "stats__") -> DataFrame:
    """``df`` with a struct of the statistics; a column of that name is replaced."""
    ship(df.sparkSession)

    @F.pandas_udf(", ".join(f"{k} double" for k in STATS))
    def stats(texts: pd.Series) -> pd.DataFrame:
        turn("stats", int)
        return pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS))

    return df.withColumn(into, stats(F.col(f"`{text}`")))


#: A condition: statistic, threshold, and whether the statistic is at most that or above it.
Condition = tuple[str, float, bool]


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctive rules and an intercept; ``column`` is the score of a row."""

    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...] = ()

    def column(self, stats: str = "stats__") -> Column:
        total = reduce(lambda a, b: a + b, [F.when(conjunction(c, stats), F.lit(w)).otherwise(F.lit(0.0)) for w, c in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def conjunction(conditions: tuple[Condition, ...], stats: str) -> Column:
    one = lambda k, at, most: F.col(f"{stats}.{k}") <= at if most else F.col(f"{stats}.{k}") > at
    return reduce(lambda a, b: a & b, [one(*c) for c in conditions])


def _paths(node, names: tuple[str, ...], above: tuple[Condition, ...] = ()):
    """Every path from the root of a fitted tree to a node below it."""
    if above:
        yield above
    if node.subtreeDepth():
        at = (names[node.split().featureIndex()], float(node.split().threshold()))
        yield from _paths(node.leftChild(), names, (*above, (*at, True)))
        yield from _paths(node.rightChild(), names, (*above, (*at, False)))


def _simplified(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """Of several bounds on one side of a statistic only the tightest."""
    best: dict[tuple[str, bool], float] = {}
    for k, at, most in path:
        now = best.get((k, most), at)
        best[k, most] = min(now, at) if most else max(now, at)
    return tuple(sorted((k, at, most) for (k, most), at in best.items()))


def fit(labelled: DataFrame, *, label: str = "y", stats: str = "stats__", trees: int = 20, depth: int = 3, penalty: float = 2e-4, seed: int = 7) -> RuleModel:
    """Fit to rows with ``stats`` and a 0/1 ``label``; rows with a null label don't count.

    Without rows, or with one class only, the model is the smoothed share of label 1.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("y"), f"{stats}.*")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if ones in (0, n):
        p = (ones + 1) / (n + 2)
        return RuleModel(float(np.log(p / (1 - p))))
    x = VectorAssembler(inputCols=list(STATS), outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", seed=seed).fit(x)
    paths = sorted({_simplified(p) for t in forest.trees for p in _paths(t._call_java("rootNode"), STATS)})
    if not paths:
        return RuleModel(float(np.log(ones / (n - ones))))
    fired = rows.select("y", F.struct(*STATS).alias(stats)).select("y", F.array(*[conjunction(p, stats).cast("double") for p in paths]).alias("r"))
    held = fired.select("y", array_to_vector("r").alias("x")).cache()
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(held)
    held.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), tuple((float(w), p) for w, p in zip(weights, paths) if w))


def training_rows(documents: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = 20_000) -> DataFrame:
    """Statistics and label of at most ``bound`` labelled rows that aren't held out, those with the smallest key hashes.

    A key labelled several times gets the majority (a tie: 1).  Null keys and labels don't count.
    """
    votes = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``bound`` rows are broadcast
    # the scan keeps its tasks; of the rows chosen only the statistics move
    return written(with_stats(texts).select("y", "stats__").repartition(8), "quality-training")


def held_out(key: Column) -> Column:
    """A fifth of the keys, never learnt from; a null key isn't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(df: DataFrame, model: RuleModel, *, text: str = "text", score: str = "score", predicted: str = "predicted", threshold: float = 0.3) -> DataFrame:
    """``df`` with a score from 0 to 1 and a 0/1 decision for each row, from its whole text alone.

    Null and empty texts have statistics of 0 and are scored like others.  Nothing
    shuffles.  Columns named like the results are replaced.
    """
    stats = free_name(df.columns, "stats__")
    scored = with_stats(df, text=text, into=stats).withColumn(score, model.column(stats)).drop(stats)
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def quality_table(documents: DataFrame, labels: DataFrame, *, bound: int = 20_000) -> DataFrame:
    """Score and decision of every document by the model fitted to ``labels``."""
    model = fit(training_rows(documents, labels, bound=bound))
    out = score_quality(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
