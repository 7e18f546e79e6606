"""Phrase collocations: which words stand together more often than their counts suggest, by direct-address tiling.

Texts are encoded once: blocks of some 250,000 words of one language with the block's own word numbers, zero between pieces. All counts
read these blocks with numpy. Units (words at first) are ranked by frequency; a pair of a unit and the word behind it has the tile of both ranks. A pair of
two head ranks is counted at its own address in the tile, by bincount; all other tiles are sparse, and their pairs are sorted coordinate lists with run
lengths. Tasks pre-aggregate both and Spark adds them up. Of the pairs of words outside the head, which are mostly rare, only those are counted that share a
bucket with enough others: a pass before that adds up buckets of 40 bits, whose sums bound the counts from above. Pairs that are frequent are the next level's units, ranked anew: so phrases of two words
become phrases of three, of which both parts of two words must be frequent, and so on.

Words and phrases are told apart by 128 bits that follow from their words and language. What travels with the tasks is bounded: ``HEAD`` units of each level, and one bit set
a level that holds the frequent units (at most 2 ** ``MOST_BITS`` bits; the fuller it is, the more rare pairs are counted in vain; nothing is lost). Everything else meets by
joins: a pair is counted under the first 64 bits of its unit and of its word, and a frequent one gets its words from the tables of both.

Defined results: a null text is empty, a null language is ``und``; A-Z are lower-cased; n counts all words of a language; occurrences may overlap and
never cross a piece; repeated rows count each time; a language without a frequent phrase has no row; of cuts with the same floored score the shortest first part
counts; scores are exact (38 digits). A piece of any length is whole in one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.llm.common import small_batches, staged, texts

#: Ends a piece; no UTF-8 text has this byte.
CUT = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + CUT * 10)
#: Words of a block; bytes of a text that are split at once; ranked head units of a level; side of a tile; pairs that are sorted at once; rows of an
#: Arrow batch; phrases that a task remembers to have told; bits of a set.
BLOCK_WORDS, SPLIT_BYTES, HEAD, SIDE, SORTED, BATCH_ROWS, TOLD, MOST_BITS = 250_000, 1 << 20, 1024, 256, 400_000, 50_000, 200_000, 28
_TIMES, _MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64), np.uint64(0xD6E8FEB86659FD93)
_COUNTS, _NAMED = "unit long, word long, c long", "k1 long, k2 long, c long, lang string, m int, phrase string"


# ---- blocks --------------------------------------------------------------------------------------------------------------------


def word_numbers(raw: bytes, numbers: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Numbers of a text's words, with CUT's between pieces; new words get the next numbers. A long text comes in parts."""
    t, begin = raw.translate(_TABLE), 0
    while begin < len(t):
        end = begin + SPLIT_BYTES
        if end < len(t):  # behind the last word that is whole, or the end of the one word that is longer
            at = max(t.rfind(b" ", begin, end), t.rfind(CUT, begin, end))
            end = at + 1 if at >= begin else min([x for x in (t.find(b" ", end), t.find(CUT, end)) if x >= 0], default=len(t))
        found = t[begin:end].replace(CUT, b" " + CUT + b" ").split()
        yield np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
        begin = end


class Block:
    """Words of one language that are being numbered."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.numbers[CUT]  # has number 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        for part in word_numbers(raw, self.numbers):
            self.parts.append(part)
            self.size += len(part)
        self.parts.append(np.zeros(1, np.int32))

    def row(self) -> tuple[int, list[bytes], bytes]:
        numbers = np.concatenate(self.parts)
        return int(np.count_nonzero(numbers)), list(self.numbers), numbers.tobytes()


def encoded(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Blocks (lang, n, words, numbers) of all texts; numbers are int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Block] = defaultdict(Block)

        def out(names: list[str]) -> pa.RecordBatch:
            rows = [(name, *open_.pop(name).row()) for name in names]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.binary()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "n", "words", "numbers"])

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                open_[name].add(raw)
                if open_[name].size > BLOCK_WORDS:
                    yield out([name])
            if sum(b.size for b in open_.values()) > 4 * BLOCK_WORDS or len(open_) > 256:
                yield out(list(open_))
        if open_:
            yield out(list(open_))

    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, n long, words array<binary>, numbers binary")


# ---- keys ----------------------------------------------------------------------------------------------------------------------


def word_keys(words: list[bytes], lang: str) -> np.ndarray:
    """(n, 2) keys of words in a language."""
    own = np.frombuffer(xxhash.xxh3_128_digest(CUT + lang.encode("utf-8", "surrogatepass")), "<u8")  # no word begins like that, so a language is none
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2) ^ own


def extended(units: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of units with one more word behind them."""
    x = units * _TIMES + words
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


#: Bits of a bucket of pairs, and those by which a key's second bit is found.
BUCKET, SECOND = np.uint64((1 << 40) - 1), 12


class BitSet:
    """Which keys may be frequent: two bits each, from the key's first 40."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        a, b = keys[:, 0] & self.mask, (keys[:, 0] >> np.uint64(SECOND)) & self.mask
        bit = lambda at: (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return (bit(a) & bit(b)).astype(bool)


def bit_set(frequent: DataFrame) -> BitSet:
    """The bit set of a table (k1): the driver gets its words of 64 bits, which are bounded, not the keys."""
    bits = min(MOST_BITS, max(16, (16 * frequent.count()).bit_length()))
    mask = (1 << bits) - 1
    at = frequent.select(F.explode(F.array(F.expr(f"k1 & {mask}L"), F.expr(f"shiftrightunsigned(k1, {SECOND}) & {mask}L"))).alias("at"))
    rows = at.groupBy(F.expr("at div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("w")).toPandas()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["i"].to_numpy(np.int64)] = rows["w"].to_numpy(np.int64).view(np.uint64)
    return BitSet(words)


class Head:
    """Ranks of the most frequent units of a level."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.order = keys, np.argsort(keys[:, 0])
        self.first = keys[self.order, 0]

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key, -1 where it is not in the head."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = self.order[np.minimum(np.searchsorted(self.first, keys[:, 0]), len(self.first) - 1)]
        return np.where((self.keys[at] == keys).all(axis=1), at, -1)


def head(frequent: DataFrame) -> Head:
    rows = frequent.orderBy(F.col("c").desc(), "k1", "k2").limit(HEAD).select("k1", "k2").toPandas()  # a bounded number of ranks
    return Head(np.ascontiguousarray(rows.to_numpy(np.int64)).view(np.uint64).reshape(-1, 2))


# ---- counts --------------------------------------------------------------------------------------------------------------------


def _block(batch: pa.RecordBatch, i: int) -> tuple[str, list[bytes], np.ndarray]:
    return batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.frombuffer(batch.column(2)[i].as_buffer(), np.int32)


def _counted(pairs: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (sort key, unit, word) with their numbers, equal ones in one row."""
    pairs = pairs[order := np.argsort(pairs[:, 0])]
    begins = np.flatnonzero(np.append(True, (pairs[1:, 1:] != pairs[:-1, 1:]).any(axis=1))) if len(pairs) else np.zeros(0, np.int64)
    n = np.diff(np.append(begins, len(pairs))) if counts is None else np.add.reduceat(counts[order], begins) if len(pairs) else counts
    found = pairs[begins].view(np.int64)
    for i in range(0, len(found), BATCH_ROWS):
        part = found[i : i + BATCH_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 1]), pa.array(part[:, 2]), pa.array(n[i : i + BATCH_ROWS].astype(np.int64))], names=["unit", "word", "c"])


class Tiles:
    """Counts of pairs (unit, word) of one task: tiles of head ranks by address, the rest as sorted coordinates."""

    def __init__(self, units: Head, words: Head):
        self.units, self.words, self.dense = units, words, {}
        self.sparse: list[np.ndarray] = []
        self.waiting = 0

    def add(self, unit_ranks: np.ndarray, word_ranks: np.ndarray, pairs: np.ndarray) -> None:
        """pairs: rows (sort key, unit, word)."""
        near = _near(unit_ranks, word_ranks)
        i, j = unit_ranks[near], word_ranks[near]
        across = -(-HEAD // SIDE)
        tile, cell = i // SIDE * across + j // SIDE, i % SIDE * SIDE + j % SIDE
        order = np.argsort(tile, kind="stable")
        tile, cell = tile[order], cell[order]
        names, begins = np.unique(tile, return_index=True)
        for name, a, b in zip(names.tolist(), begins, [*begins[1:], len(tile)][: len(names)], strict=True):
            if name not in self.dense:
                self.dense[name] = np.zeros(SIDE * SIDE, np.int64)
            self.dense[name] += np.bincount(cell[a:b], minlength=SIDE * SIDE)
        self.sparse.append(pairs[~near])
        self.waiting += len(self.sparse[-1])

    def flush(self) -> Iterator[pa.RecordBatch]:
        pairs, self.sparse, self.waiting = np.concatenate(self.sparse), [], 0
        return _counted(pairs)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.sparse:
            yield from self.flush()
        across = -(-HEAD // SIDE)
        for name, tile in self.dense.items():
            cells = np.flatnonzero(tile)
            i, j = name // across * SIDE + cells // SIDE, name % across * SIDE + cells % SIDE
            unit, word = self.units.keys[i, 0], self.words.keys[j, 0]
            yield from _counted(np.stack([unit, unit, word], axis=1), tile[cells])


def phrases(words: np.ndarray, numbers: np.ndarray, sets: list[BitSet], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one block, for 2 to most words: begins of all phrases whose two parts of one word less may be frequent, their keys, and those of the parts in front.

    words: keys by number. The sets of levels 1, 2, ... thin out what the next level looks at.
    """
    may = sets[0][words]
    may[0] = False
    at = np.flatnonzero(may[numbers])
    keys = words[numbers[at]]
    for m in range(2, most + 1):
        follow = np.flatnonzero(np.diff(at) == 1)
        at, units = at[follow], keys[follow]
        keys = extended(units, words[numbers[at + m - 1]])
        yield at, keys, units
        if m <= len(sets) and m < most:
            often = sets[m - 1][keys]
            at, keys = at[often], keys[often]


def frequent_words(blocks: DataFrame, least: int) -> DataFrame:
    """Words that occur ``least`` times in their language: k1, k2, c, lang, m (1) and phrase."""

    def count_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, numbers = _block(batch, i)
                if len(words) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) - 1)), pa.array(words[1:], pa.binary()), pa.array(np.bincount(numbers, minlength=len(words))[1:])], names=["lang", "w", "c"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                keys = np.concatenate([word_keys([w], x) for w, x in zip(words, lang, strict=True)]).view(np.int64)
                shown = pa.array([w.decode("utf-8", "replace") for w in words])
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), batch.column(2), batch.column(0), pa.array(np.ones(len(words), np.int32)), shown], names=["k1", "k2", "c", "lang", "m", "phrase"])

    small_batches(blocks.sparkSession)
    counts = blocks.select("lang", "words", "numbers").mapInArrow(count_, "lang string, w binary, c long").groupBy("lang", "w").agg(F.sum("c").alias("c"))
    return counts.filter(F.col("c") >= least).mapInArrow(name, _NAMED)


def named(pairs: DataFrame, units: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (unit, word, c) as units of one word more: k1, k2, c, lang, m and phrase."""
    u = units.select(F.col("k1").alias("unit"), F.col("k2").alias("u2"), "lang", F.col("m").alias("m0"), F.col("phrase").alias("front"))
    w = words.select(F.col("k1").alias("word"), F.col("k2").alias("w2"), F.col("phrase").alias("last"))
    both = pairs.join(u, "unit").join(w, "word").select("unit", "u2", "word", "w2", "c", "lang", (F.col("m0") + 1).alias("m"), F.concat_ws(" ", "front", "last").alias("phrase"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lanes = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(4)]
                keys = extended(np.stack(lanes[:2], axis=1), np.stack(lanes[2:], axis=1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), *batch.columns[4:]], names=["k1", "k2", "c", "lang", "m", "phrase"])

    return both.mapInArrow(run, _NAMED)


def _near(unit_ranks: np.ndarray, word_ranks: np.ndarray) -> np.ndarray:
    return (unit_ranks >= 0) & (word_ranks >= 0)


def pair_buckets(blocks: DataFrame, words: BitSet, heads: Head) -> DataFrame:
    """k1 (a bucket) and c: how many pairs of words that may be frequent, not both of the head, fall into it."""
    shared = blocks.sparkSession.sparkContext.broadcast((words, heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, heads = shared.value
        held, waiting = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(found), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + BATCH_ROWS].view(np.int64)), pa.array(n[i : i + BATCH_ROWS])], names=["k1", "c"])

        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, numbers = _block(batch, i)
                of_words = word_keys(words, lang)
                ranked = heads.ranks(of_words)
                at, keys, _ = next(phrases(of_words, numbers, [often], 2))
                held.append(keys[~_near(ranked[numbers[at]], ranked[numbers[at + 1]]), 0] & BUCKET)
                waiting += len(held[-1])
                if waiting > SORTED:
                    yield from out()
                    held, waiting = [], 0
        if held:
            yield from out()

    small_batches(blocks.sparkSession)
    return blocks.select("lang", "words", "numbers").mapInArrow(run, "k1 long, c long").groupBy("k1").agg(F.sum("c").alias("c"))


def phrase_counts(blocks: DataFrame, sets: list[BitSet], units: Head, words: Head, among: BitSet | None = None) -> DataFrame:
    """unit, word and c of phrases of len(sets) + 1 words whose parts may be frequent; beyond the tiles of the head those that ``among`` holds."""
    spark, m = blocks.sparkSession, len(sets) + 1
    shared = spark.sparkContext.broadcast((sets, units, words, among))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, units, heads, among = shared.value
        tiles = Tiles(units, heads)
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, numbers = _block(batch, i)
                of_words = word_keys(words, lang)
                ranked = heads.ranks(of_words)
                *_, (at, keys, parts) = phrases(of_words, numbers, sets, m)
                of_units, of_next = ranked[numbers[at]] if m == 2 else units.ranks(parts), ranked[numbers[at + m - 1]]
                pairs = np.stack([keys[:, 0], parts[:, 0], of_words[numbers[at + m - 1], 0]], axis=1)
                if among is not None:
                    some = among[keys] | _near(of_units, of_next)
                    of_units, of_next, pairs = of_units[some], of_next[some], pairs[some]
                tiles.add(of_units, of_next, pairs)
                if tiles.waiting > SORTED:
                    yield from tiles.flush()
        yield from tiles.rows()

    small_batches(spark)
    return blocks.select("lang", "words", "numbers").mapInArrow(run, _COUNTS).groupBy("unit", "word").agg(F.sum("c").alias("c"))


# ---- scores --------------------------------------------------------------------------------------------------------------------


def cuts(found: DataFrame) -> DataFrame:
    """found (lang, m, phrase, ...) with a row for each cut: cut, and the keys (l1, l2) of the first words and (r1, r2) of the rest."""
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, (lang, phrase) in enumerate(zip(batch.column(names.index("lang")).to_pylist(), batch.column(names.index("phrase")).to_pylist(), strict=True)):
                of_words = word_keys(phrase.encode("utf-8").split(b" "), lang)
                for k in range(1, len(of_words)):
                    both = []
                    for part in (of_words[:k], of_words[k:]):
                        key = part[:1]
                        for w in part[1:]:
                            key = extended(key, w)
                        both.append(key[0])
                    rows.append((i, k))
                    keys.append(np.concatenate(both))
            if rows:
                taken = batch.take(pa.array([i for i, _ in rows]))
                sides = np.array(keys, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([k for _, k in rows], pa.int32()), *[pa.array(np.ascontiguousarray(sides[:, c])) for c in range(4)]], names=[*names, "cut", "l1", "l2", "r1", "r2"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInArrow(run, f"{kinds}, cut int, l1 long, l2 long, r1 long, r2 long")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact where the products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, below = (wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")
    return F.call_function("div", top, below)


def collocations(docs: DataFrame, least: int = 100, words: int = 5, percent: int = 100, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of 2 to ``words`` words that occur ``least`` times in their language.

    Left out are phrases that stand inside a longer one with at least percent / 100 of their occurrences (the longer one is frequent, too). It is enough to
    look at those with one word more, because no phrase occurs more often than a part of it.
    """
    blocks = staged(encoded(docs, lang, text))
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    often = [staged(frequent_words(blocks, least))]
    sets, heads = [bit_set(often[0])], [head(often[0])]
    among = bit_set(staged(pair_buckets(blocks, sets[0], heads[0]).filter(F.col("c") >= least).select("k1")))
    while len(often) < words:
        pairs = phrase_counts(blocks, sets, heads[-1], heads[0], among if len(sets) == 1 else None).filter(F.col("c") >= least)
        often.append(staged(named(pairs, often[-1], often[0])))
        if len(often) < words:
            sets.append(bit_set(often[-1]))
            heads.append(head(often[-1]))
    found = often[1]
    for t in often[2:]:
        found = found.unionByName(t)
    counts = often[0].unionByName(found).select("k1", "k2", "c")
    found = found.withColumnRenamed("c", "a")
    cut = staged(cuts(found))
    side = lambda name: counts.select(F.col("k1").alias(f"{name}1"), F.col("k2").alias(f"{name}2"), F.col("c").alias(name))
    scored = cut.join(side("l"), ["l1", "l2"]).join(side("r"), ["r1", "r2"]).join(totals, "lang")
    best = scored.groupBy("k1", "k2").agg(F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r", "n")).alias("x"))
    inner = cut.filter("m > 2")
    parts = inner.filter("cut = 1").select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), "a").unionByName(inner.filter("cut = m - 1").select(F.col("l1").alias("k1"), F.col("l2").alias("k2"), "a"))
    longer = parts.groupBy("k1", "k2").agg(F.max("a").alias("longer"))
    kept = found.join(longer, ["k1", "k2"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
    return kept.join(best, ["k1", "k2"]).select("lang", "phrase", "a", "x.l", "x.r", "x.n", "x.score")


def ranked(found: DataFrame, top: int = 2000) -> DataFrame:
    """The first ``top`` of each language by score, then occurrences, then phrase, with their rank; Spark drops later ones before the shuffle, too."""
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
