"""Quality classifier by Bradley-Terry ranking.

A document's worth is a linear score of its features. For a pair of a better and a worse document the probability that the better
one wins is the logistic function of the difference of their scores; the weights minimise the logistic loss over preference pairs
(a document labelled 1 against one labelled 0), by gradient steps in numpy. Features are thermometer codes of the text measures
with edges at training quantiles, so that the linear score can bend.

The threshold is the quantile of the training scores at the share of documents labelled 0. Scores are returned on a 0-to-1 scale
that puts this threshold at 0.7: sigmoid(steepness * (score - threshold) + logit(0.7)).

Fitting reads at most ``sample`` labelled rows outside the held-out fold. Every whole text is scored, within the tasks, by one dot product.

Defined results: null texts count as empty; a null label or a label without a document is ignored; a document labelled twice
counts with its lower label, and of rows with its id that with the smallest measures; with labels of one kind only every score is 0.7 and
every document is predicted 1; repeated rows get the same score; rows with a null id are scored, not learned from, and not held out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanings.llm.common import crc_mod
from gleanings.llm.quality_rules import training_rows
from gleanings.llm.text_stats import MEASURES, text_stats, with_measures

CUT = 0.7


class Ranker:
    """Edges (features x bins), weights of the thermometer codes, the threshold and the steepness of the scale."""

    def __init__(self, x: np.ndarray, good: np.ndarray, bins: int = 24, steps: int = 600, pairs: int = 4096, rate: float = 0.1, decay: float = 1e-3, seed: int = 3):
        self.edges = np.quantile(x, np.linspace(0, 1, bins + 2)[1:-1], axis=0).T if len(x) else np.zeros((x.shape[1], bins))
        self.weights, self.threshold, self.steepness = np.zeros(self.edges.size), 0.0, 0.0
        if not good.any() or good.all():
            return
        code, random = self.code(x), np.random.default_rng(seed)
        better, worse = np.flatnonzero(good), np.flatnonzero(~good)
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            d = code[random.choice(better, pairs)] - code[random.choice(worse, pairs)]
            loses = 1 / (1 + np.exp(np.clip(d @ self.weights, -30, 30)))
            slope = -(loses @ d) / pairs + decay * self.weights
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            self.weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        scores = code @ self.weights
        self.threshold = float(np.quantile(scores, 1 - good.mean()))
        self.steepness = 1.0 / max(1e-6, float(np.std(scores)))

    def code(self, x: np.ndarray) -> np.ndarray:
        """Thermometer codes: 1 for each edge that a value exceeds."""
        return (x[:, :, None] > self.edges[None]).reshape(len(x), -1).astype(float)


def classify(docs: DataFrame, labels: DataFrame, fold: int = 2, folds: int = 4, sample: int = 20_000, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs. Rows in the held-out fold are not learned from."""
    stats = with_measures(text_stats(docs))
    seen = labels.filter(crc_mod("doc_id", folds) != fold)
    rows = training_rows(docs, seen, sample, label).toPandas().sort_values(["h", "doc_id"], kind="stable")
    ranker = Ranker(rows[list(MEASURES)].to_numpy(float), rows["label"].to_numpy() == 1)
    raw = F.lit(0.0)
    for name, edges, weights in zip(MEASURES, ranker.edges, ranker.weights.reshape(ranker.edges.shape), strict=True):
        steps = [(float(e), float(w)) for e, w in zip(edges, weights, strict=True) if w]
        if steps:
            bars = ", ".join(f"named_struct('e', {e!r}D, 'w', {w!r}D)" for e, w in steps)
            raw = raw + F.expr(f"aggregate(array({bars}), 0D, (s, b) -> s + if({name} > b.e, b.w, 0D))")
    scale = F.lit(ranker.steepness) * (raw - F.lit(ranker.threshold)) + F.lit(float(np.log(CUT / (1 - CUT))) + 1e-12)
    score = 1 / (1 + F.exp(-scale))
    return stats.select("doc_id", (crc_mod("doc_id", folds) == fold).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
