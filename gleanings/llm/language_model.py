"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, beside a unigram base.

Tokens are the lower-cased words of a text and one end. Counts of all training tokens are gathered by a shuffle with map-side combine.
The ``model_words`` most frequent tokens are the model's vocabulary, in classes of ``CLASS`` words by rank; all other tokens are one
more class, within which a token has its smoothed share of counts, unseen tokens included as one type.

The model is log-bilinear: the two previous words' vectors add up to a prediction, whose product with a class's or a word's vector
plus its bias is the log of an unnormalised probability. log p(word) = log p(class) + log p(word in class). Both factors are trained in
numpy by noise-contrastive estimation: the true class (word) is to be told from draws of the unigram distribution (within the class).
Training documents are dealt to shards by a hash of their id (of their text where the id is null); the number of shards follows from the
number of training tokens. A shard is read in the order of hashes and trained on once, from the same start; the parameters of all shards
are averaged by their numbers of tokens, in slices and thirty-two shards at a time. So the model is a function of the table, however it is
partitioned, and no task gathers the parameters of all shards. Scoring multiplies batches of predictions with the class and word matrices and normalises
them exactly, so probabilities of all tokens add up to one.

Exact counts of the ``frequent`` most frequent tokens of up to ``LONGEST`` bytes travel with the scoring tasks (a bounded table); all others meet
their counts in an equi-join. Nothing that grows with the corpus reaches the driver.

Defined results: null texts count as empty and have one token, the end; rows with a null id are in no held-out fold; with no training
rows every count is zero, and both scores are those of uniform unseen tokens; repeated rows score alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanings.llm.common import crc_mod, small_batches, staged, texts

END = b"\n"  # no word has a line end in it
CLASS = 64
#: Bytes of the longest token that travels; training tokens a shard; slices of the parameters; shards averaged at a time; tokens a block.
LONGEST, SHARD_TOKENS, SLICES, FAN_IN, BLOCK = 64, 2_000_000, 64, 32, 65_536


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, and the end."""
    found = raw.lower().split()
    found.append(END)
    return found


def token_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """word (binary) and c of all tokens of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for raw in texts(batch.column(0)):
                seen.update(tokens(raw))
            if len(seen) > flush:
                yield out()
        if seen:
            yield out()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words by falling count, their counts, and totals over all training tokens; the first ``m`` are the model's words."""

    words: list[bytes]
    counts: np.ndarray
    m: int
    total: int
    distinct: int

    @property
    def classes(self) -> int:
        """Number of classes of model words; the class of all other words comes after them."""
        return -(-self.m // CLASS)


def vocabulary(counts: DataFrame, frequent: int = 200_000, model_words: int = 4096) -> Vocabulary:
    """At most ``frequent`` words: those above the lowest count bin that fits."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = counts.filter(F.length("word") <= LONGEST)
    bins = short.groupBy(F.floor(F.log2("c") * 8).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()  # a few hundred rows at most
    least, held = math.inf, 0
    for b in sorted(bins, key=lambda r: -r.b):
        held += b.n
        if held > frequent:
            break
        least = b.least
    rows = short.filter(F.col("c") >= (least if least < math.inf else 2**62)).collect()
    rows.sort(key=lambda r: (-r.c, bytes(r.word)))
    return Vocabulary([bytes(r.word) for r in rows], np.array([r.c for r in rows], np.int64), min(model_words, len(rows)), total, distinct)


class LogBilinear:
    """Parameters and their use. Word ids: 0..m-1 model words, m any other, m+1 the beginning of a text."""

    def __init__(self, counts: np.ndarray, others: float, size: int = 16, seed: int = 5):
        m, k = len(counts), -(-len(counts) // CLASS)
        self.m, self.k, random = m, k, np.random.default_rng(seed)
        padded = np.zeros(k * CLASS)
        padded[:m] = counts
        mass = np.append(padded.reshape(k, CLASS).sum(1), others)
        self.class_noise = np.maximum(mass, 1e-9) / max(mass.sum(), 1e-9)
        self.class_noise /= self.class_noise.sum()
        within = padded.reshape(k, CLASS)
        self.word_noise = within / np.maximum(within.sum(1, keepdims=True), 1e-9)
        steps = np.cumsum(self.word_noise, axis=1)
        self.word_steps = np.where(steps >= steps[:, -1:], 2.0, steps)[:, : CLASS - 1] if k else steps  # no draw goes beyond the last word
        draw = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.parts = {
                "one": draw(m + 2, size),
                "two": draw(m + 2, size),
                "classes": draw(k + 1, size),
                "class_bias": np.log(self.class_noise).astype(np.float32),
                "words": draw(k * CLASS, size),
                "word_bias": np.maximum(np.log(self.word_noise.reshape(-1)), -1e4).astype(np.float32),
            }

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, p in self.parts.items():
            self.parts[name] = np.asarray(flat[at : at + p.size], np.float32).reshape(p.shape)
            at += p.size

    def contexts(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before and the one before that of every token of concatenated texts, which begin at ``begins``."""
        start = self.m + 1
        one, two = np.empty_like(ids), np.empty_like(ids)
        one[1:], two[2:], one[:1], two[:2] = ids[:-1], ids[:-2], start, start
        one[begins] = two[begins] = start
        second = begins + 1
        two[second[second < len(ids)]] = start
        return one, two

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 0.1, step: int = 8192, noise: int = 12, seed: int = 11) -> int:
        """Noise-contrastive steps with Adagrad over (ids, begins) of concatenated texts; the number of tokens."""
        random, squares, seen = np.random.default_rng(seed), {n: np.full(p.shape, 1e-3, np.float32) for n, p in self.parts.items()}, 0
        for ids, begins in batches:
            one, two = self.contexts(ids, begins)
            for i in range(0, len(ids), step):
                part = slice(i, i + step)
                for name, (rows, slope) in self._slopes(ids[part], one[part], two[part], noise, random).items():
                    squares[name][rows] += slope**2
                    self.parts[name][rows] -= rate * slope / np.sqrt(squares[name][rows])
            seen += len(ids)
        return seen

    def _slopes(self, ids, one, two, noise, random) -> dict:
        p = self.parts
        known = ids < self.m
        group = np.where(known, ids // CLASS, self.k)
        r = p["one"][one] + p["two"][two]
        dr = np.zeros_like(r)
        slopes = {}
        # classes: one draw of noise classes for the step
        drawn = random.choice(self.k + 1, noise, p=self.class_noise)
        offset = np.log(noise * self.class_noise).astype(np.float32)
        true = (r * p["classes"][group]).sum(1) + p["class_bias"][group] - offset[group]
        false = r @ p["classes"][drawn].T + p["class_bias"][drawn] - offset[drawn]
        g_true, g_false = -_sigmoid(-true), _sigmoid(false)
        dr += g_true[:, None] * p["classes"][group] + g_false @ p["classes"][drawn]
        dense, bias = np.zeros_like(p["classes"]), np.zeros_like(p["class_bias"])
        _add(dense, group, g_true[:, None] * r)
        np.add.at(dense, drawn, g_false.T @ r)
        bias += np.bincount(group, g_true, self.k + 1).astype(np.float32)
        np.add.at(bias, drawn, g_false.sum(0))
        slopes["classes"], slopes["class_bias"] = (slice(None), dense), (slice(None), bias)
        # words within classes: one draw of noise words for each class in the step
        at = np.flatnonzero(known)
        if len(at):
            word, rk = ids[at], r[at]
            log_noise = np.log(np.maximum(noise * self.word_noise.reshape(-1), 1e-20)).astype(np.float32)
            true = (rk * p["words"][word]).sum(1) + p["word_bias"][word] - log_noise[word]
            g = -_sigmoid(-true)
            drk = g[:, None] * p["words"][word]
            dense, bias = np.zeros_like(p["words"]), np.bincount(word, g, len(p["word_bias"])).astype(np.float32)
            _add(dense, word, g[:, None] * rk)
            order = np.argsort(group[at].astype(np.int16), kind="stable")
            bounds = np.searchsorted(group[at][order], np.arange(self.k + 1))
            draws, eye = random.random((self.k, noise)), np.eye(CLASS, dtype=np.float32)
            for c in range(self.k):
                mine = order[bounds[c] : bounds[c + 1]]
                if len(mine):
                    w = np.searchsorted(self.word_steps[c], draws[c], "right")
                    spread = eye[w]  # draws of the same word add up
                    w += c * CLASS
                    x, block = rk[mine], slice(c * CLASS, (c + 1) * CLASS)
                    g_false = _sigmoid(x @ p["words"][w].T + p["word_bias"][w] - log_noise[w])
                    drk[mine] += g_false @ p["words"][w]
                    dense[block] += spread.T @ (g_false.T @ x)
                    bias[block] += g_false.sum(0) @ spread
            dr[at] += drk
            slopes["words"], slopes["word_bias"] = (slice(None), dense), (slice(None), bias)
        for name, context in (("one", one), ("two", two)):
            dense = np.zeros_like(p[name])
            _add(dense, context, dr)
            slopes[name] = (slice(None), dense)
        return slopes

    def log_probabilities(self, ids: np.ndarray, begins: np.ndarray, step: int = 16384) -> np.ndarray:
        """Natural log of p(token | the two before it), of the whole class for words outside the model."""
        one, two = self.contexts(ids, begins)
        out = np.empty(len(ids), np.float64)
        p = self.parts
        for i in range(0, len(ids), step):
            mine = ids[i : i + step]
            r = p["one"][one[i : i + step]] + p["two"][two[i : i + step]]
            group = np.where(mine < self.m, mine // CLASS, self.k)
            logits = r @ p["classes"].T + p["class_bias"]
            got = logits[np.arange(len(mine)), group]
            got -= _log_sum(logits)
            order = np.argsort(group.astype(np.int16), kind="stable")
            bounds = np.searchsorted(group[order], np.arange(self.k + 1))
            for c in range(self.k):
                at = order[bounds[c] : bounds[c + 1]]
                if len(at):
                    block = slice(c * CLASS, (c + 1) * CLASS)
                    logits = r[at] @ p["words"][block].T + p["word_bias"][block]
                    own = logits[np.arange(len(at)), mine[at] - c * CLASS]
                    got[at] += own - _log_sum(logits)
            out[i : i + step] = got
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; the rows are used up."""
    top = logits.max(1)
    logits -= top[:, None]
    return np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)) + top


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """into[rows] += values, with repeated rows added up."""
    order = np.argsort(rows.astype(np.int16) if into.shape[0] < 32768 else rows, kind="stable")
    sorted_rows = rows[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    into[sorted_rows[begins]] += np.add.reduceat(values[order], begins, axis=0)


def _as_ids(found: list[list[bytes]], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of frequent words (-1: not in it) of concatenated texts, and where each text begins."""
    get = index.get
    ids = np.array([get(w, -1) for words in found for w in words], np.int64)
    begins = np.cumsum([0, *map(len, found)])[:-1]
    return ids, begins


def _blocks(rows: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of texts put together to blocks of BLOCK tokens or a little more, with the places at which texts begin."""
    held, n = [], 0
    for ids in rows:
        held.append(ids)
        n += len(ids)
        if n >= BLOCK:
            yield np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held)])[:-1]
            held, n = [], 0
    if held:
        yield np.concatenate(held).astype(np.int64), np.cumsum([0, *map(len, held)])[:-1]


def train(docs: DataFrame, shared, model: LogBilinear, total: int) -> None:
    """Train on the texts of docs (doc_id, text), shard by shard, and average. ``shared`` is the broadcast vocabulary, total the number of tokens."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark, shards = docs.sparkSession, max(1, -(-total // SHARD_TOKENS))
    start = spark.sparkContext.broadcast(model)

    def as_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        index = {w: i for i, w in enumerate(vocab.words[: vocab.m])}
        for batch in batches:
            found = [np.array([index.get(w, vocab.m) for w in tokens(t)], np.uint16).tobytes() for t in texts(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["shard", "h", "doc_id", "text_hash", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = start.value.flat()
        rows = ((shard, ids) for batch in batches for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for shard, mine in groupby(rows, lambda r: r[0]):
            local = start.value
            local.load(first.copy())
            seen = local.train(_blocks(np.frombuffer(ids, np.uint16) for _, ids in mine))
            slices = np.array_split(local.flat().astype(np.float64), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * SLICES, pa.int64()), pa.array(range(SLICES), pa.int64()), pa.array([float(seen)] * SLICES), pa.array(slices, pa.list_(pa.float64()))], names=["part", "slice", "seen", "flat"])
            local.load(first)

    small_batches(spark)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    rows = docs.select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("h"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    ids = rows.mapInArrow(as_ids, "shard long, h long, doc_id long, text_hash long, ids binary")
    dealt = ids.repartition("shard").sortWithinPartitions("shard", "h", "doc_id", "text_hash").select("shard", "ids")
    trained = dealt.mapInArrow(run, "part long, slice long, seen double, flat array<double>").select("part", "slice", "seen", array_to_vector("flat").alias("v"))
    while shards > 1:
        trained = trained.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("part")).agg(Summarizer.mean(F.col("v"), F.col("seen")).alias("v"), F.sum("seen").alias("seen"))
        shards = -(-shards // FAN_IN)
    # one set of parameters, whatever the input
    found = trained.select("slice", vector_to_array("v").alias("flat")).collect()
    if found:
        model.load(np.concatenate([r.flat for r in sorted(found, key=lambda r: r.slice)]))


def score_texts(docs: DataFrame, fold: int = 1, folds: int = 5, frequent: int = 200_000, model_words: int = 4096) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = rows.filter(F.col("doc_id").isNull() | (crc_mod("doc_id", folds) != fold))
    counts = staged(token_counts(seen))
    vocab = vocabulary(counts, frequent, model_words)
    in_model = int(vocab.counts[: vocab.m].sum())
    model = LogBilinear(vocab.counts[: vocab.m], vocab.total - in_model)
    shared = spark.sparkContext.broadcast(vocab)
    if vocab.m:
        train(seen, shared, model, vocab.total)
    ready = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, lbl = shared.value, ready.value
        index = {w: i for i, w in enumerate(v.words)}
        logs = np.log10(v.counts + 0.5)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [tokens(t) for t in texts(batch.column(1))]
            ids, begins = _as_ids(found, index)
            n = np.array([len(x) for x in found])
            doc = np.repeat(np.arange(len(found)), n)
            held = ids >= 0
            outside = (ids < 0) | (ids >= v.m)
            log = lbl.log_probabilities(np.where(outside, v.m, ids), begins) / math.log(10)
            of_count = np.where(held, logs[np.where(held, ids, 0)] if len(logs) else 0.0, 0.0)
            add = lambda x: np.bincount(doc, x, len(found))
            rare: list[Counter] = [Counter() for _ in found]
            flat = [w for words in found for w in words]
            for i in np.flatnonzero(~held).tolist():
                rare[doc[i]][flat[i]] += 1
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()), pa.array([k for r in rare for k in r.values()], pa.int64())], names=["word", "k"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(found))),
                    batch.column(0),
                    pa.array(n.astype(np.int64)),
                    pa.array(add(held).astype(np.int64)),
                    pa.array(add(of_count)),
                    pa.array(add(outside).astype(np.int64)),
                    pa.array(add(np.where(outside, of_count, 0.0))),
                    pa.array(add(log)),
                    pa.ListArray.from_arrays(pa.array(ends), entries),
                ],
                names=["row", "doc_id", "n_tokens", "n_held", "held_log", "n_outside", "outside_log", "model_log", "rare"],
            )
            row += len(found)

    schema = "row long, doc_id long, n_tokens long, n_held long, held_log double, n_outside long, outside_log double, model_log double, rare array<struct<word: binary, k: long>>"
    small_batches(spark)
    scored = staged(rows.mapInArrow(run, schema))
    least = int(vocab.counts.min()) if len(vocab.counts) else 2**62
    few = counts.filter((F.col("c") < least) | (F.length("word") > LONGEST))
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").join(few, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("k") * F.log10(c + 0.5)).alias("rare_log"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("n_rare")).withColumnRenamed("row", "_r")
    full = scored.drop("rare").join(rare, F.col("row") == F.col("_r"), "left")
    rare_log, n_rare = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("n_rare", F.lit(0)).cast("long")
    others, types = vocab.total - in_model, vocab.distinct - vocab.m
    return full.select(
        "doc_id",
        (F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) == fold)).alias("held_out"),
        "n_tokens",
        (F.col("n_held") + n_rare).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("held_log") + rare_log - F.col("n_tokens") * math.log10(vocab.total + 0.5 * (vocab.distinct + 1))).alias("base_score"),
        (F.col("model_log") + F.col("outside_log") + rare_log - F.col("n_outside") * math.log10(others + 0.5 * (types + 1))).alias("score"),
    )
