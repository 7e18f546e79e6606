"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanings.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m int, a long, k1 long, score long, words string, c long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 1, 2, 3, 4, "w", 5) for i, (t, lang) in enumerate(rows)], SCHEMA)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, most=5, percent=100, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, le, r, n[lang], s) for i, (s, a, p, le, r) in enumerate(kept[:top], 1)]
    return sorted(out)


def prose(seed, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["The", "É", "x\x00y", " ", "ß"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["New  York City", "of the people\tby the people", "a a a a a a", "state-of-the-art, indeed", "end. of"]
    out = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choices(words, weights)[0] for _ in range(r.randint(0, 30))]
        out.append(("".join(p + r.choice([" ", " ", " ", ", ", "\n", "\t", "!? "]) for p in parts), r.choice(["en", "en", "en", "de", None, "und"])))
    return out


AWKWARD = [(None, "en"), ("", "en"), (" \t ", None), (".,;", "fr"), ("one", "es"), ("word " * 40_000, "en"), ("x" * 300_000 + " y z", "de")]


def got(df, top=2000):
    return sorted(map(tuple, C.ranked(df, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize(("seed", "least", "most", "percent"), [(1, 5, 5, 100), (2, 12, 4, 100), (3, 30, 5, 80), (4, 10, 2, 100)])
def test_against_plain_counting(spark, monkeypatch, seed, least, most, percent):
    rows = prose(seed) + AWKWARD
    if seed != 1:  # small tiles, blocks and sets: most pairs are sparse, many blocks, many collisions; workers take these by value
        monkeypatch.setattr(C, "MOST_BITS", 16)
        monkeypatch.setattr(C, "HEAD", 5)
    df = table(spark, rows).repartition(3)
    assert got(C.collocations(df, least, most, percent)) == brute(rows, least, most, percent)


def test_words_that_are_names_of_languages(spark):
    """A word in a language is another than that language's name in the language of the word."""
    rows = [("en es en en", "es"), ("es es en de, und en", "en"), ("de en und", None), ("und en de", "de")] * 8
    assert got(C.collocations(table(spark, rows), 8)) == brute(rows, 8)


def test_first_of_each_language_and_no_rows(spark):
    rows = prose(9)
    assert got(C.collocations(table(spark, rows), 5), top=7) == brute(rows, 5, top=7)
    assert got(C.collocations(table(spark, []))) == [] == got(C.collocations(table(spark, AWKWARD[:5])))


def test_texts_are_split_alike_in_parts(monkeypatch):
    monkeypatch.setattr(C, "SPLIT_BYTES", 7)
    for text in ["a bb  ccc,dddddddddddddddddd ee.f", ",,", "", "x" * 50, "q " * 20, " lead\ttail "]:
        block = C.Block()
        block.add(text.encode())
        n, words, numbers = block.row()
        back = [words[i] for i in np.frombuffer(numbers, np.int32)]
        pieces = [w.encode() for p in re.split(r"[.,;:!?\x0A-\x0D]", text) for w in [*re.findall(r"[^\x20\x09]+", p), "￾"]]
        assert back == [C.CUT if w == "￾".encode() else w for w in pieces] and n == sum(w != "￾".encode() for w in pieces)


def test_tiles_count_near_and_far_pairs_alike():
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**63, (3000, 2)).astype(np.uint64)
    head = C.Head(keys[: C.HEAD])
    left, right = r.zipf(1.3, 20_000) % 3000, r.zipf(1.3, 20_000) % 3000
    tiles, total = C.Tiles(head, head), Counter()
    for a in range(0, 20_000, 5000):
        i, j = left[a : a + 5000], right[a : a + 5000]
        tiles.add(head.ranks(keys[i]), head.ranks(keys[j]), np.stack([C.extended(keys[i], keys[j])[:, 0], keys[i, 0], keys[j, 0]], axis=1))
    for batch in tiles.rows():
        for k1, k2, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            total[k1, k2] += c
    assert total == Counter(zip(keys[left, 0].view(np.int64).tolist(), keys[right, 0].view(np.int64).tolist(), strict=True)) and len(tiles.dense) > 4


def test_scores_are_exact(spark):
    rows = [(10**13 - 1, 10**15 + 7, 10**13 - 1, 10**13 + 3), (999_999_999_989, 10**17 + 3, 10**12 + 39, 10**12 + 61), (100, 150, 100, 149), (1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", C.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s"))
    assert [r.s for r in df.collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]
