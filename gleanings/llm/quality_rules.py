"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditions.

The list is grown for the rejected class. Labelled rows are divided by a hash of their id into a growing and a pruning part. A rule
starts empty and takes the threshold condition with the highest information gain until it covers no good row of the growing part;
then conditions are dropped from its end while that raises its precision on the pruning part. A rule that is precise enough on
all rows still uncovered joins the list, what it covers is set aside, and the next rule is grown; the first one that is not precise
enough ends the list. Texts that no rule meets are kept.

Only fitting reads a bounded sample: at most ``sample`` labelled rows, those with the smallest hash of their id. The counts cover every
text in full and the rules are applied to all.

Defined results: null texts count as empty; documents without a label take no part in fitting; labels that are null or whose
documents are missing are ignored; a document labelled twice counts with its lower label; of rows with the same id and different texts
one is learned from, that with the smallest measures in their order; without bad labels there are no rules and nothing but the base
conditions rejects. Every row is judged by its own text, so repeated rows are judged alike; rows with a null id are judged, not learned from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanings.llm.text_stats import MEASURES, text_stats, with_measures

#: (measure, "<=" or ">", threshold)
Condition = tuple[str, str, float]


def base_failed() -> Column:
    """Too short, or more than 30 % of the words repeat within the text."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = 20_000, label: str = "quality") -> DataFrame:
    """doc_id, h, label and measures of at most ``sample`` labelled documents, those with the smallest hash of their id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_l")).agg(F.min(label).cast("int").alias("label"))
    chosen = known.withColumn("h", F.xxhash64("_l")).orderBy("h", "_l").limit(sample)
    # the sample is bounded by its parameter, so it may be sent to every task; only its texts are counted
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(F.broadcast(chosen), F.col("_d") == F.col("_l"))
    stats = with_measures(text_stats(rows.select(F.col("_d").alias("doc_id"), "text", F.struct("h", "label").alias("of")), carry="of"))
    once = stats.groupBy("doc_id", F.col("of.h").alias("h"), F.col("of.label").alias("label")).agg(F.min(F.struct(*MEASURES)).alias("m"))
    return once.select("doc_id", "h", "label", "m.*")


def learn(rows, names: list[str], least_precision: float = 0.95, least_covered: int = 8, most_conditions: int = 4, most_rules: int = 24) -> list[list[Condition]]:
    """Rules for label 0 from a pandas frame with the named measures, label and h."""
    rows = rows.sort_values(["h", "doc_id"], kind="stable")
    x, bad, prune = rows[names].to_numpy(float), rows["label"].to_numpy() == 0, (np.arange(len(rows)) % 3 == 0)
    left, rules = np.ones(len(rows), bool), []
    while (left & bad).sum() >= least_covered and len(rules) < most_rules:
        rule = _prune(_grow(x, bad, left & ~prune, most_conditions), x, bad, left & prune)
        met = left & _met(rule, x)
        if not rule or (met & bad).sum() < least_covered or (met & bad).sum() < least_precision * met.sum():
            break
        rules.append([(names[f], sign, float(t)) for f, sign, t in rule])
        left &= ~met
    return rules


def _met(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, t in rule:
        out &= (x[:, f] <= t) if sign == "<=" else (x[:, f] > t)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, among: np.ndarray, most: int) -> list:
    rule: list = []
    while len(rule) < most and (among & ~bad).any() and (among & bad).any():
        p, n = (among & bad).sum(), (among & ~bad).sum()
        best = (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(np.quantile(x[among & bad, f], np.linspace(0, 1, 33)))
            good_values, bad_values = np.sort(x[among & ~bad, f]), np.sort(x[among & bad, f])
            for sign in ("<=", ">"):
                # a threshold lies halfway to the nearest good value, so that unseen rows at the margin are told apart evenly
                for t in values:
                    if sign == "<=":
                        i = np.searchsorted(good_values, t, "right")
                        cut = (t + good_values[i]) / 2 if i < n else t
                        p1, n1 = np.searchsorted(bad_values, cut, "right"), np.searchsorted(good_values, cut, "right")
                    else:
                        i = np.searchsorted(good_values, t, "left")
                        cut = (t + good_values[i - 1]) / 2 if i else t - abs(t) * 1e-9 - 1e-12
                        p1, n1 = p - np.searchsorted(bad_values, cut, "right"), n - np.searchsorted(good_values, cut, "right")
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best[0]:
                            best = (gain, (f, sign, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        among = among & _met([best[1]], x)
    return rule


def _prune(rule: list, x: np.ndarray, bad: np.ndarray, among: np.ndarray) -> list:
    def worth(r: list) -> float:
        met = among & _met(r, x)
        return ((met & bad).sum() - (met & ~bad).sum()) / max(1, met.sum())

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def as_column(rules: list[list[Condition]]) -> Column:
    """The decision list as one conditional expression: false where a rule rejects, else true."""
    chain = None
    for rule in rules:
        test = F.lit(True)
        for name, sign, threshold in rule:
            test = test & ((F.col(name) <= threshold) if sign == "<=" else (F.col(name) > threshold))
        chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def learned(docs: DataFrame, labels: DataFrame, sample: int = 20_000, label: str = "quality") -> list[list[Condition]]:
    """The rules that the labelled documents give."""
    return learn(training_rows(docs, labels, sample, label).toPandas(), list(MEASURES))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000, label: str = "quality") -> DataFrame:
    """doc_id, the counts and measures, base_failed and kept of every row of docs."""
    return _judged(text_stats(docs), learned(docs, labels, sample, label))


def _judged(counts: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    return with_measures(counts).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & as_column(rules))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns; each is judged by its own text, null and repeated ids included, where it stands."""
    rows = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return _judged(text_stats(rows, carry="_row"), learned(docs, labels, **options)).filter("kept").select("_row.*")
