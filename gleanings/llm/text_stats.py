"""Counts over whole texts that quality rules and classifiers read."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanings.llm.common import per_batch

#: Names of the counts, in the order of ``counts``.
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_commas", "n_distinct", "n_same_next", "longest_word", "n_one_letter"]
WINDOW = 8

_SYMBOLS = b"#*$%&|<>"
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) | 1 for i in range(WINDOW)], np.uint64)


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Number of words that lie in a window of ``width`` words which occurs at least twice, its first occurrence included.

    Windows are told apart by a rolling hash first; those whose hash recurs are then compared word by word.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows += hashes[i : i + n] * _MULTIPLIERS[i]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    doubtful = np.zeros(n, bool)
    doubtful[order[1:][same]] = doubtful[order[:-1][same]] = True
    at = np.flatnonzero(doubtful).tolist()
    times = Counter(tuple(words[i : i + width]) for i in at)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if times[tuple(words[i : i + width])] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of NAMES. Words are runs of characters other than ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (
        len(words),
        len(text) - spaces,
        int(octets[list(_SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        int(octets[65:91].sum()),
        int(octets[48:58].sum()),
        int(octets[list(b"!?")].sum()),
        int(octets[list(b".,;:")].sum()),
        len(set(words)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
        max(map(len, words), default=0),
        sum(len(w) == 1 for w in words),
    )


def text_stats(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id and the counts, as longs, of every row of docs (doc_id, text); null counts as empty. With carry that column comes first, as it is."""
    front = [docs[carry]] if carry else []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([counts(t or "") for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(NAMES))
        return pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), *[pa.array(found[:, i]) for i in range(len(NAMES))]], names=[*([carry] if carry else []), "doc_id", *NAMES])

    schema = T.StructType([*([docs.schema[carry]] if carry else []), *[T.StructField(n, T.LongType()) for n in ("doc_id", *NAMES)]])
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *front), run, schema)


#: Shares and means made of the counts, as SQL: the measures that models see. Every one is defined for empty texts.
MEASURES = {
    "words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "comma_share": "n_commas / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "same_next_share": "n_same_next / greatest(n_words, 1)",
    "longest_word": "ln(1 + longest_word)",
    "words_a_line": "ln(1 + n_words / greatest(n_lines, 1))",
    "one_letter_share": "n_one_letter / greatest(n_words, 1)",
}


def with_measures(stats: DataFrame) -> DataFrame:
    """The counts and, beside them, MEASURES as doubles."""
    return stats.withColumns({k: F.expr(v).cast("double") for k, v in MEASURES.items()})
