"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after ".", "!" or "?" before white space, and at line ends. Inside a sentence of more than
``long_sentence`` words there are further cuts after words chosen by their own hash, so that the same passage is cut alike wherever it
stands. From every sentence a span runs over as many following ones (at least two sentences in all) as give ``least_words`` words.

Passages need not begin and end with sentences, so there is a second kind of span, the anchor: ``anchor_words`` words that begin at any
word. Of every ``window`` successive beginnings the one with the smallest hash is an anchor, wherever it stands, so two texts that
share anchor_words + window - 1 words (50) share an anchor. As window < anchor_words, the anchors of a passage leave no gaps.
Texts are also cut where anchors begin and end; what all these cuts leave are the pieces that are counted and removed.

Spans are hashed (128 bits: two polynomials over hashes of the lower-cased words, from running sums) and joined over all documents; the first occurrence of a span, by document id (then a hash of the text) and
place, stays, and every piece that a later occurrence covers is removed.

Only hashes and places are shuffled. The first places are found with map-side combine; the join back to all spans is an equi-join
whose skewed keys Spark splits, so a passage that very many documents share is not gathered in one task.

Defined results: null texts stay null and remove nothing; empty texts stay empty; documents with a null id are left as they are;
rows with the same id and text are one document and lose the same pieces; rows with the same id and different texts are different
documents, in the order of a hash of their text; repeats within one document count like those between documents; what is left of a
text keeps its own white space. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanings.llm.common import small_batches, staged

_END = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|[\x0A]+")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Odd numbers: the bases of two polynomial hashes modulo 2^64, and factors that mix bits.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX, _MIX_WORD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo 2^64."""
    global _POWERS
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for b in _BASES for x in (b, pow(b, -1, 2**64))]
    return [p[:n] for p in _POWERS]


class Cut:
    """A text's words, sentences, anchors and pieces, as arrays of places.

    ``begins`` has the bytes at which words begin, ``whole`` the ends of sentences, ``anchors`` the words at which anchors begin and
    ``ends`` the ends of the pieces that all cuts leave. ``digests`` hashes runs of words from running sums.
    """

    def __init__(self, raw: bytes, long_sentence: int = 24, one_in: int = 8, anchor_words: int = 26, window: int = 25):
        blank = _BLANK[np.frombuffer(raw, np.uint8)]
        starts = ~blank
        starts[1:] &= blank[:-1]
        self.size, self.anchor_words, self.begins = len(raw), anchor_words, np.flatnonzero(starts)
        words = raw.lower().split()
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.down, self.sums = [], []
        powers = _powers(len(word) + 1)
        for k, x in enumerate((word, (word ^ (word >> np.uint64(29))) * _MIX_WORD)):
            up, down = powers[2 * k], powers[2 * k + 1]
            self.down.append(down)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])]))

        ends = [m.end() for m in _END.finditer(raw)]
        if not ends or ends[-1] < len(raw):
            ends.append(len(raw))
        ends = np.array(ends, np.int64)
        before = np.searchsorted(self.begins, ends)  # words before each end
        sizes = np.diff(before, prepend=0)
        if (sizes > long_sentence).any():
            # inside long sentences there is a cut behind words chosen by their own hash
            inner = np.repeat(sizes > long_sentence, sizes) & (word % np.uint64(one_in) == 0)
            inner[before[before > 0] - 1] = False
            ends = np.union1d(ends, self.begins[np.flatnonzero(inner) + 1])
        self.whole = ends if len(raw) else ends[:0]

        self.anchors = self._anchors(window)
        bounds = np.append(self.begins, len(raw))
        bounds[:1] = 0  # white space before the first word goes with it
        self.anchor_begins, self.anchor_ends = bounds[self.anchors], bounds[self.anchors + anchor_words]
        self.ends = np.union1d(np.union1d(self.whole, self.anchor_begins[self.anchor_begins > 0]), self.anchor_ends) if len(self.anchors) else self.whole

    def digests(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the words from i up to j, the same wherever they stand."""
        out = []
        for sums, down in zip(self.sums, self.down, strict=True):
            h = (sums[j] - sums[i]) * down[i]
            out.append((h ^ (h >> np.uint64(32))) * _MIX)
        return out[0], out[1]

    def _anchors(self, window: int) -> np.ndarray:
        """Words at which anchors begin: the smallest hash of each window, the last of equal ones."""
        n = len(self.begins) - self.anchor_words + 1
        if n < window:
            return np.zeros(0, np.int64)
        i = np.arange(n)
        h = self.digests(i, i + self.anchor_words)[0]
        best, reach = i, 1
        while reach < window:
            step = min(reach, window - reach)
            left, right = best[:-step], best[step:]
            best, reach = np.where(h[right] <= h[left], right, left), reach + step
        return np.unique(best)

    def piece(self, begin: np.ndarray) -> np.ndarray:
        """Number of the piece that begins at a byte: it follows the one that ends there."""
        return np.searchsorted(self.ends, begin) + (begin > 0)

    def spans(self, least_words: int, least_sentences: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last piece and the two hashes of the span of each sentence, as far as the text has words enough, and of each anchor."""
        before = np.searchsorted(self.begins, self.whole)
        start = before - np.diff(before, prepend=0)
        last = np.maximum(np.searchsorted(before, start + least_words), np.arange(len(start)) + least_sentences - 1)
        k = np.flatnonzero((last < len(start)) & (before > start))  # a blank sentence begins no span of its own
        last = last[k]
        from_ = np.concatenate([[0], self.whole[:-1]])[k] if len(k) else k
        i, j = np.concatenate([start[k], self.anchors]), np.concatenate([before[last], self.anchors + self.anchor_words])
        begin, end = np.concatenate([from_, self.anchor_begins]), np.concatenate([self.whole[last], self.anchor_ends])
        return self.piece(begin), np.searchsorted(self.ends, end), *self.digests(i, j)


def sentences(raw: bytes, **cuts) -> list[tuple[int, int]]:
    """Bounds of the pieces of a text, sentences or parts of them, which together are the whole text."""
    ends = Cut(raw, **cuts).ends.tolist()
    return list(zip([0, *ends], ends, strict=False))


def span_table(docs: DataFrame, least_words: int = 20, **cuts) -> DataFrame:
    """h1, h2 (the digest), doc_id, text_hash and place (first piece << 32 | last piece) of every span of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Cut(text.encode("utf-8", "surrogatepass"), **cuts).spans(least_words) for text in batch.column(2).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), pa.int32())
            first, last, h1, h2 = (np.concatenate([np.zeros(0, np.int64), *[f[k].view(np.int64) for f in found]]) for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(of), batch.column(1).take(of), pa.array(first << 32 | last)], names=["h1", "h2", "doc_id", "text_hash", "place"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").filter("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, text_hash long, place long")


def removed_sentences(docs: DataFrame, least_words: int = 20, **cuts) -> DataFrame:
    """doc_id, text_hash and covered: the places of spans whose pieces are to be removed, one row for each document that loses any."""
    rows = staged(span_table(docs, least_words, **cuts))
    # written out, so that the join deals out both sides anew and Spark can split a hot span; so is what it finds, which is little
    repeated = staged(rows.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").select("h1", "h2"))
    shared = staged(rows.join(repeated, ["h1", "h2"]))
    begin = F.struct("doc_id", "text_hash", "place")
    origins = staged(shared.groupBy("h1", "h2").agg(F.min(begin).alias("origin")))
    later = shared.join(origins, ["h1", "h2"]).filter(begin != F.col("origin"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("covered"))


def cut_text(text: str, covered: list, **cuts) -> tuple[str, int, int]:
    """What is left of a text, its number of pieces and the number removed."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = Cut(raw, **cuts).ends
    if not covered:
        return text, len(ends), 0
    places, gone = np.array(covered, np.int64), np.zeros(len(ends) + 1, np.int64)
    np.add.at(gone, places >> 32, 1)
    np.add.at(gone, (places & 0xFFFFFFFF) + 1, -1)
    keep = np.cumsum(gone[:-1]) == 0
    ends = ends.tolist()
    left = b"".join(raw[a:b] for a, b, k in zip([0, *ends], ends, keep.tolist(), strict=False) if k)
    return left.decode("utf-8", "surrogatepass"), len(ends), int((~keep).sum())


def dedup_passages(docs: DataFrame, least_words: int = 20, **cuts) -> DataFrame:
    """doc_id, text (without repeated passages), n_sentences and n_removed (both in pieces) of every row of docs."""
    gone = removed_sentences(docs, least_words, **cuts).withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut_text(t, c, **cuts) if t is not None else (None, 0, 0) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            left, n, removed = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_sentences", "n_removed"])

    small_batches(docs.sparkSession)
    joined = rows.join(gone, (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left").select("doc_id", "text", "covered")
    return joined.mapInArrow(run, "doc_id long, text string, n_sentences long, n_removed long")
