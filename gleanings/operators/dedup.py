"""Deduplication. "First" always means first by an explicit order column."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.functions import urls
from gleanings.session import written


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key, all columns kept."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def dedup_exact(articles: DataFrame, order: str, url_column: str = "url") -> DataFrame:
    """The first article of each URL fingerprint."""
    return first_per(articles.withColumn("fingerprint", urls.fingerprint(F.col(url_column))), ["fingerprint"], order)


def new_only(batch: DataFrame, archive: DataFrame) -> DataFrame:
    """Articles whose fingerprint is not archived, nor their (title, source_name)."""
    left = batch.join(archive.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return left.join(archive.select("title", "source_name").distinct(), ["title", "source_name"], "left_anti")


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits (query_ord, rank, url) of several queries in one list: the first of each normalised URL."""
    return first_per(hits.withColumn("norm_url", urls.normalize_search_url(F.col("url"))).filter("norm_url <> ''"), ["norm_url"], "query_ord", "rank")


def exclude_seen(hits: DataFrame, used: DataFrame) -> DataFrame:
    """Hits (series_id, url) whose key the same series has not used."""
    keyed = hits.withColumn("url_key", urls.url_key(F.col("url")))
    return keyed.join(used.select("series_id", urls.url_key(F.col("url")).alias("url_key")).distinct(), ["series_id", "url_key"], "left_anti")


def collapse_sources(sources: DataFrame, order: str, name_column: str = "name") -> DataFrame:
    """One row for each source name without regard to case and outer spaces; the first spelling stays."""
    return first_per(sources.withColumn("source_key", F.lower(F.trim(F.col(name_column)))), ["source_key"], order)


def dedupe_terms(terms: DataFrame, limit: int, keys: DataFrame | None = None, templates: tuple[str, ...] = ()) -> DataFrame:
    """terms (key, priority, ord, term): trimmed, the first of each spelling, seeds (lower priority) first, then the limit.

    Of keys (key, name) those without any term get the templates, with "{}" standing for their name.
    """
    if keys is not None:
        lacking = keys.join(terms.filter("trim(term) <> ''").select("key").distinct(), "key", "left_anti")
        generic = lacking.select("key", F.lit(0).alias("priority"), F.posexplode(F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("name")) for t in templates])).alias("ord", "term"))
        terms = terms.select("key", "priority", "ord", "term").unionByName(generic)
    first = first_per(terms.withColumn("term", F.trim("term")).filter("term <> ''").withColumn("_t", F.lower("term")), ["key", "_t"], "priority", "ord")
    place = F.row_number().over(W.partitionBy("key").orderBy("priority", "ord"))
    return first.withColumn("place", place).filter(F.col("place") <= limit).drop("_t")


def resolve_sources(candidates: DataFrame, seeds: DataFrame, limit: int = 20) -> DataFrame:
    """Sources (topic, topic_ord, ord, name, url) of each topic: http(s), distinct, limited; a topic without any takes its seeds;
    a URL belongs to the first topic that has it."""

    def cleaned(df: DataFrame) -> DataFrame:
        ok = df.withColumn("url", F.regexp_replace(F.trim("url"), "/+$", "")).filter(F.col("url").rlike("(?i)^https?://"))
        ok = first_per(ok, ["topic", "url"], "ord")
        return ok.withColumn("_n", F.row_number().over(W.partitionBy("topic").orderBy("ord"))).filter(F.col("_n") <= limit).drop("_n")

    good = cleaned(candidates)
    fallback = cleaned(seeds).join(good.select("topic").distinct(), "topic", "left_anti")
    both = first_per(good.unionByName(fallback), ["url"], "topic_ord", "ord")
    return both.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("url"))).withColumn("type", urls.looks_like_feed_url(F.col("url")))


def pick_version(versions: DataFrame) -> DataFrame:
    """versions (url, kind, body, ok, dated) with kinds plain, rendered, feed, page, primary, full -> url, chosen kind and body."""
    of = lambda k: F.max(F.when(F.col("kind") == k, F.struct("body", "ok", "dated"))).alias(k)
    v = versions.groupBy("url").agg(*map(of, ("plain", "rendered", "feed", "page", "primary", "full")))
    n = lambda k: F.coalesce(F.length(F.col(f"{k}.body")), F.lit(0))
    take = lambda k: F.struct(F.lit(k).alias("kind"), F.col(f"{k}.body").alias("body"))
    rescued = (~F.col("plain.ok") | ~F.col("plain.dated")) & F.col("rendered.ok")
    fetched = F.when(F.col("rendered").isNotNull() & (F.col("plain").isNull() | rescued | ((n("rendered") > 0) & (n("plain") <= 1.2 * n("rendered")) & ~F.col("plain.ok"))), take("rendered")).when(F.col("plain").isNotNull(), take("plain"))
    fed = F.when(F.col("page").isNotNull() & (n("page") > 1.5 * n("feed")), take("page")).when(F.col("feed").isNotNull(), take("feed"))
    extracted = F.when((n("primary") < 500) & (n("full") >= 2 * n("primary")) & F.col("full").isNotNull(), take("full")).when(F.col("primary").isNotNull(), take("primary"))
    return v.withColumn("c", F.coalesce(fetched, fed, extracted, take("page"), take("full"))).select("url", F.col("c.kind").alias("kind"), F.col("c.body").alias("body"))


def letters(text: Column) -> Column:
    """What the shingles of a text are made of: link targets and all but letters, digits and _ removed, lower-cased."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\]\([^)]*\)", "]"), r"[^\p{L}\p{N}_]+", "")


def shingle_set(of: str, width: int = 5) -> np.ndarray:
    """Distinct character shingles of a text's letters(), as ascending 64-bit hashes; fewer letters than ``width`` are one shingle."""
    codes = np.frombuffer(of.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if 0 < len(codes) < width:
        codes = np.pad(codes, (0, width - len(codes)))  # 0 is no letter
    n = max(0, len(codes) - width + 1)
    h = np.zeros(n, np.uint64)
    for begin in range(0, width, 3):  # three code points of 21 bits at a time
        for k in range(begin, min(begin + 3, width)):
            h ^= codes[k : k + n] << np.uint64(21 * (k - begin))
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if n else h


def shingle_overlap(a: Column, b: Column, width: int = 5) -> tuple[Column, Column, Column]:
    """Of the shingles of two texts' letters(): how many both have, either has, and the smaller set has. The sets stay in their row's task."""

    @F.pandas_udf("both long, na long, nb long")
    def sizes(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t in zip(x, y, strict=True):
            one, two = shingle_set(s, width), shingle_set(t, width)
            rows.append((_shared(one, two), len(one), len(two)))
        return pd.DataFrame(rows, columns=["both", "na", "nb"])

    found = sizes(a, b)
    both, na, nb = (found[c] for c in ("both", "na", "nb"))
    return both, na + nb - both, F.least(na, nb)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two ascending sets share."""
    if 8 * len(x) < len(y):
        return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def shingle_classes(docs: DataFrame, id_column: str, text: Column, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(id, class_id, chars) of every document that has shingles, and (class_id, n, letters) of every class.

    Documents with the same set of shingles are one class, named by its smallest id; nothing of a class but that one's letters is used further on. Sets are
    made in the task that has the text, and only two keys of each are shuffled. The second table is not written: who reads it twice writes it.
    """
    rows = _lettered(docs, id_column, text)
    members, named = _classes(written(_keyed(rows, width)))
    return members, _representatives(_keyed(rows, width, "letters"), named).select("class_id", "n", "letters")


def _lettered(docs: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(id, chars, letters). Texts without letters are left to _keyed(): a filter here would be pushed down, and letters() made twice, or made before a join."""
    return docs.select(F.col(id_column).cast("long").alias("id"), F.length(text).alias("chars"), letters(text).alias("letters"))


def _keyed(rows: DataFrame, width: int, also: str = "") -> DataFrame:
    """(id, chars, n, k1, k2) of rows (id, chars, letters) that have letters: two keys of each set of shingles, and also its letters or the keys of its MinHash bands."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column("letters"), ""))
            found, least = [], []
            for x in batch.column("letters"):
                s = shingle_set(x.as_py(), width)
                found.append((len(s), *np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()))
                if also == "bands":
                    least.append(_minima(s))
            n, k1, k2 = zip(*found, strict=True) if found else ((), (), ())
            own = {"": [], "letters": [batch.column("letters")], "bands": [pa.array(list(_band_keys(least)), pa.list_(pa.int64()))]}[also]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chars"), *(pa.array(v, pa.int64()) for v in (n, k1, k2)), *own], names=["id", "chars", "n", "k1", "k2", *[also] * len(own)])

    return rows.mapInArrow(keys, "id long, chars int, n long, k1 long, k2 long" + {"": "", "letters": ", letters string", "bands": ", bands array<long>"}[also])


def _classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class_id, chars) of every keyed document, and (class_id, k1, k2, n) of every class."""
    least = written(keyed.groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.first("n").alias("n")))
    members = keyed.select("id", "chars", "k1", "k2").join(least, ["k1", "k2"]).select("id", "class_id", "chars")
    # an id that occurs twice may stand for one class only once
    return members, least.groupBy("class_id").agg(F.min(F.struct("k1", "k2", "n")).alias("x")).select("class_id", "x.*")


def _representatives(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """The keyed row that names each class."""
    return keyed.withColumnRenamed("id", "class_id").drop("chars", "n").join(named, ["class_id", "k1", "k2"]).dropDuplicates(["class_id", "k1", "k2"])


def near_pairs(docs: DataFrame, id_column: str, text: Column, percent: int = 82, width: int = 5, metric: str = "overlap") -> DataFrame:
    """(a, b, overlap, least): pairs of classes that are near by at least percent / 100; a is the one with fewer shingles.

    metric: overlap (shared shingles by those of the smaller set, which is at least Jaccard, so the larger of the two) or jaccard.
    """
    members, sets = shingle_classes(docs, id_column, text, width)
    return _near_pairs(sets, percent, metric, width, _ranges(members))


def _ranges(members: DataFrame) -> int:
    """Ranges of sets, of some four blocks each, so that few blocks are cut short by the end of a range."""
    chars = members.filter("id = class_id").agg(F.sum("chars").alias("c")).first().c or 0
    return max(1, -(-chars // (4 * BLOCK_LETTERS)))


def _near(overlap, either, least, percent: int, metric: str):
    return overlap * 100 >= (either if metric == "jaccard" else least) * percent


#: Letters (or shingles, where sets come as such) and sets of a block.
BLOCK_LETTERS, BLOCK_SETS = 1 << 23, 1 << 13


def _near_pairs(sets: DataFrame, percent: int, metric: str = "overlap", width: int = 5, ranges: int = 0) -> DataFrame:
    """Near pairs (a, b, overlap, least) of sets (class_id, n, letters), or of sets of hashes (class_id, s), sorted in so many ranges (0: as Spark has it).

    Sets in order of their size are packed into blocks, and every two blocks meet in a task that reads both: nothing but the texts is shuffled, once, and
    written, once, and a task holds a few blocks however many there are. Their number of pairs is quadratic; for Jaccard, blocks whose sizes are too far apart do not meet.
    """
    if metric not in ("overlap", "jaccard"):
        raise ValueError("metric is overlap or jaccard")
    if "s" in sets.columns:
        sets = sets.select("class_id", F.size("s").cast("long").alias("n"), F.col("s").alias("letters"))
    kind = sets.schema["letters"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([held[0][1]]), pa.array([held[0][0]]), pa.array([held[-1][1]]), pa.array([[h[0] for h in held]]), pa.array([[h[2] for h in held]])], names=["low", "first", "high", "ids", "items"])
        for batch in batches:
            for i, n, item in zip(*(batch.column(c) for c in ("class_id", "n", "letters")), strict=True):
                held.append((i.as_py(), n.as_py(), item.as_py()))
                weight += len(held[-1][2])
                if weight >= BLOCK_LETTERS or len(held) >= BLOCK_SETS:
                    yield out()
                    held, weight = [], 0
        if held:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], _Block] = {}

        def block(batch: pa.RecordBatch, row: int, side: str) -> _Block:
            key = (batch.column(f"{side}low")[row].as_py(), batch.column(f"{side}first")[row].as_py())
            if key not in kept:
                while len(kept) > 3:
                    del kept[next(iter(kept))]
                kept[key] = _Block.of(batch.column(f"{side}ids")[row].as_py(), batch.column(f"{side}items")[row].as_py(), width)
            return kept[key]

        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (block(batch, row, side) for side in "xy")
                for a, b, both, least in _met(x, y, percent, metric):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, both, least)], names=["a", "b", "overlap", "least"])

    ordered = sets.repartitionByRange(*[ranges][: ranges > 0], "n", "class_id").sortWithinPartitions("n", "class_id").select("class_id", "n", "letters")
    blocks = written(ordered.mapInArrow(pack, f"low long, first long, high long, ids array<long>, items array<{kind}>"), rows_a_file=1)
    x, y = (blocks.select(*[F.col(c).alias(side + c) for c in blocks.columns]) for side in "xy")
    beside = F.struct("xlow", "xfirst") <= F.struct("ylow", "yfirst")
    if metric == "jaccard":
        beside &= F.col("xhigh") * 100 >= F.col("ylow") * percent
    tiles = x.hint("shuffle_replicate_nl").join(y, beside).select(*[side + c for side in "xy" for c in ("low", "first", "ids", "items")])
    return written(tiles.mapInArrow(meet, "a long, b long, overlap long, least long"))


@dataclass(frozen=True)
class _Block:
    """Sets one behind the other: their ids, where each begins, and of each hash its set and its code. hashes are all different ones in order, coded by how often they are: the most frequent ones, which are looked up most, lie together."""

    ids: np.ndarray
    at: np.ndarray
    row: np.ndarray
    code: np.ndarray
    hashes: np.ndarray
    code_of: np.ndarray
    often: np.ndarray

    @staticmethod
    def of(ids: list[int], items: list, width: int) -> _Block:
        sets = [shingle_set(x, width) if isinstance(x, str) else np.unique(np.array(x, np.int64).view(np.uint64)) for x in items]
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = _order(flat)
        new = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
        begins = np.flatnonzero(new)
        often = np.diff(np.append(begins, len(flat)))
        by_often = np.argsort(-often, kind="stable")
        code_of = np.empty(len(begins), np.int64)
        code_of[by_often] = np.arange(len(begins))
        code = np.empty(len(flat), np.int64)
        code[order] = np.repeat(code_of, often)
        return _Block(np.array(ids, np.int64), np.concatenate(([0], np.cumsum(n))), np.repeat(np.arange(len(n), dtype=np.int32), n), code, flat[order[begins]], code_of, often[by_often])


def _order(flat: np.ndarray) -> np.ndarray:
    """An argsort of hashes by one sort of 64-bit numbers: as many leading bits as leave room for a place; the few places where these are the same for different hashes are put right."""
    bits = np.uint64(len(flat).bit_length())
    packed = (flat >> bits << bits) | np.arange(len(flat), dtype=np.uint64)
    packed.sort()
    order, top = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), packed >> bits
    same = flat[order]
    for t in np.unique(top[1:][(top[1:] == top[:-1]) & (same[1:] != same[:-1])]):
        some = slice(np.searchsorted(top, t), np.searchsorted(top, t, "right"))
        order[some] = order[some][np.argsort(same[some], kind="stable")]
    return order


#: Sets of a block, and hashes that they share with the other one's, that are counted at once; rare hashes that a pair must share at least, beyond what it may miss.
ROWS, PLACES, LEAST_COMMON = 256, 1 << 22, 24


def _met(x: _Block, y: _Block, percent: int, metric: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Near pairs (a, b, overlap, least) of a set in x with a later one in y.

    A near set y misses at most n - must hashes of a set of n in x, so it has at least k of any n - must + k of them. These are the ones that are rarest in y; pairs
    with fewer in common are left out, and all others are compared in full: y's hashes are marked, and x's counted where they are marked.
    """
    n, size = np.diff(x.at), np.diff(y.at)
    # sets of y are no smaller than x's and than the smallest of y, and Jaccard asks for more the larger they are
    must = np.minimum(-(-(n + np.maximum(n, size.min())) * percent // (100 + percent)), n) if metric == "jaccard" else -(-n * percent // 100)
    k = np.minimum(np.maximum(LEAST_COMMON, n // 16), must)
    # x's hashes by y's codes; all that y has not share one more
    at = np.minimum(np.searchsorted(y.hashes, x.hashes), len(y.hashes) - 1)
    there = np.empty(len(x.hashes), np.int64)
    there[x.code_of] = np.where(y.hashes[at] == x.hashes, y.code_of[at], len(y.hashes))
    code = there[x.code]
    rarity = np.minimum(np.append(y.often, 0), (1 << 14) - 1)[code].astype(np.uint64)
    # one number for set, rarity and place, so that one sort ranks all sets
    ranked = (x.row.astype(np.uint64) << np.uint64(50)) | (rarity << np.uint64(36)) | np.arange(len(code), dtype=np.uint64)
    ranked.sort()
    ranked = ranked[(np.arange(len(ranked)) - x.at[x.row] < (n - must + k)[x.row]) & (ranked >> np.uint64(36) & np.uint64((1 << 14) - 1) > 0)]
    chosen = (ranked & np.uint64((1 << 36) - 1)).astype(np.int64)
    chosen = (code[chosen] << 32) | x.row[chosen]
    chosen.sort()
    rows, count = chosen & ((1 << 32) - 1), np.bincount(chosen >> 32, minlength=len(y.hashes))
    begin = np.cumsum(count) - count
    hits = np.flatnonzero((count > 0)[y.code])
    begin, count, of = begin[y.code[hits]], count[y.code[hits]], y.row[hits]
    so_far, marked = np.concatenate(([0], np.cumsum(count))), np.zeros(len(y.hashes) + 1, bool)
    of_row = np.searchsorted(of, np.arange(len(size) + 1))
    low = 0
    while low < len(size):
        high = max(low + 1, min(low + ROWS, int(np.searchsorted(so_far[of_row], so_far[of_row[low]] + PLACES, "right")) - 1))
        some = slice(of_row[low], of_row[high])
        each = count[some]
        place = np.repeat(begin[some] - so_far[some], each) + np.arange(so_far[some.start], so_far[some.stop])
        common = np.bincount(np.repeat((of[some] - low) * np.int64(len(n)), each) + rows[place], minlength=(high - low) * len(n)).reshape(high - low, len(n))
        j, i = np.nonzero(common >= k)
        j += low
        low = high
        apart = i < j if x is y else np.ones(len(i), bool)
        if metric == "jaccard":
            apart &= n[i] * 100 >= size[j] * percent
        i, j = i[apart], j[apart]
        both, last = np.zeros(len(i), np.int64), -1
        for c, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            if b != last:  # pairs with one y follow each other
                marked[y.code[y.at[last] : y.at[last + 1]] if last >= 0 else slice(0)] = False
                marked[y.code[y.at[b] : y.at[b + 1]]] = True
                last = b
            both[c] = np.count_nonzero(marked[code[x.at[a] : x.at[a + 1]]])
        marked[:] = False
        good = _near(both, n[i] + size[j] - both, n[i], percent, metric)
        if good.any():
            yield x.ids[i[good]], y.ids[j[good]], both[good], n[i[good]]


#: Minima of a MinHash, rows of a band, and sets of a part of a band's bucket: two parts meet in a task.
PERMUTATIONS, BAND_ROWS, MOST_IN_BUCKET = 128, 8, 512
_random = np.random.default_rng(11)
_TIMES = _random.integers(1, 2**63, BAND_ROWS, np.uint64) | np.uint64(1)

#: The order in which a range of hashes that a set has none in looks for another one's.
_LENDERS = np.argsort(_random.random((PERMUTATIONS, PERMUTATIONS)), axis=1)

#: Shingles of a block of candidates: two blocks meet in a tile, which holds their sets.
TILE_SHINGLES = 1 << 21

#: Candidates of at least so many shingles are first compared by sketches: counts of a set's hashes in so many buckets; sketches of a block.
SKETCHED, SKETCH, SKETCHES = 2048, 4096, 16384


def minhash_pairs(sets: DataFrame, percent: int = 82, width: int = 5) -> DataFrame:
    """Pairs of sets (class_id, n, letters) near by Jaccard, found by MinHash bands: the variant for large input, which may miss some.

    Sixteen bands of eight of 128 minima let a pair at the threshold of 0.82 meet with a chance of 0.97, and nearer ones almost surely. What meets is
    compared in full: all sets of a bucket, however many they are. near_pairs(metric="jaccard") finds all.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [_minima(shingle_set(x.as_py(), width)) for x in batch.column("letters")]
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(list(_band_keys(least)), pa.list_(pa.int64()))], names=["class_id", "bands"])

    sets = written(sets)
    size = sets.select("class_id", "n")
    met = _met_in_bands(sets.select("class_id", "letters").mapInArrow(bands, "class_id long, bands array<long>"), size, percent)
    return _compared(met, size, sets.select("class_id", "letters"), percent, width)


def _minhash_classes(docs: DataFrame, id_column: str, text: Column, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The members of shingle_classes() and their minhash_pairs(). A text's keys and bands are made in one pass; what is read again is the texts that meet another."""
    keyed = written(_keyed(_lettered(docs, id_column, text), width, "bands"))
    members, named = _classes(keyed)
    named = written(named)
    met = _met_in_bands(_representatives(keyed, named).select("class_id", "bands"), named, percent)
    ids = written(met.select(F.explode(F.array("a", "b")).alias("class_id")).distinct())
    again = _lettered(docs.join(ids, F.col(id_column).cast("long") == F.col("class_id"), "left_semi"), id_column, text)
    texts = written(_representatives(_keyed(again, width, "letters"), named).select("class_id", "letters"))
    return members, _compared(met, named, texts, percent, width)


def _minima(h: np.ndarray) -> np.ndarray:
    """The smallest hash of an ascending set in each of 128 ranges of hashes (one permutation hashing); a range without any borrows that of a random other one.

    Two sets agree at each place with the chance of their Jaccard similarity, as with one permutation a place (optimal densification), for the price of 128 searches.
    """
    at = np.searchsorted(h, np.arange(PERMUTATIONS, dtype=np.uint64) * np.uint64(2**64 // PERMUTATIONS))
    filled = np.append(at[1:], len(h)) > at
    if not filled.all():
        empty = np.flatnonzero(~filled)
        lenders = _LENDERS[empty]
        at[empty] = at[lenders[np.arange(len(empty)), filled[lenders].argmax(axis=1)]]
    return h[at]


def _band_keys(least: list[np.ndarray]) -> np.ndarray:
    """A key of each band of each set's minima."""
    rows = np.array(least, np.uint64).reshape(len(least), -1, BAND_ROWS) if least else np.zeros((0, 1, BAND_ROWS), np.uint64)
    return (rows * _TIMES).sum(axis=2, dtype=np.uint64).view(np.int64)


def _met_in_bands(banded: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """(a, b, least): sets (class_id, bands) that share a band's key and whose sizes (class_id, n) are not too far apart; a is the one with fewer shingles, which least counts.

    Large buckets are dealt into parts of some ``MOST_IN_BUCKET`` sets, and every two parts meet in a task. Sets that share several keys meet in the first of these bands, so no pair comes twice.
    """
    tile = ["band", "key", "low", "high"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.logical_and.reduce([batch.column(c).to_numpy() == batch.column(c)[batch.num_rows - 1].as_py() for c in tile])
            last = int(np.flatnonzero(same)[0])  # the last tile waits for its other rows
            if last or not held or any(held[0].column(c)[0] != batch.column(c)[0] for c in tile):
                yield from pairs([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        yield from pairs(held)

    def pairs(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in batches):
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        band, key, low, high, part, ids, n = (rows.column(c).to_numpy() for c in (*tile, "part", "id", "n"))
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        ends = np.flatnonzero(np.concatenate((np.logical_or.reduce([v[1:] != v[:-1] for v in (band, key, low, high)]), [True]))) + 1
        found, held = [], 0
        for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            within, earlier = low[begin] == high[begin], band[begin]
            left, right = (np.arange(begin, end),) * 2 if within else (begin + np.flatnonzero(part[begin:end] == side[begin]) for side in (low, high))
            for place, i in enumerate(left.tolist()):
                j = right[place + 1 :] if within else right
                j = j[_near(np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), np.minimum(n[i], n[j]), percent, "jaccard")]  # a pair shares no more than its smaller set
                j = j[~(bands[j, :earlier] == bands[i, :earlier]).any(axis=1)]
                if len(j):
                    less = (n[i] < n[j]) | ((n[i] == n[j]) & (ids[i] < ids[j]))
                    found.append((np.where(less, ids[i], ids[j]), np.where(less, ids[j], ids[i]), np.minimum(n[i], n[j])))
                    held += len(j)
            if found and (held > 1 << 18 or end == len(ids)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], names=["a", "b", "least"])
                found, held = [], 0

    each = written(banded.select(F.col("class_id").alias("id"), F.posexplode("bands").alias("band", "key")))
    buckets = each.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1")
    met = each.join(buckets, ["band", "key"]).withColumn("parts", F.ceil(F.col("c") / MOST_IN_BUCKET)).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: F.struct(F.least("part", other).alias("low"), F.greatest("part", other).alias("high")))
    items = banded.join(size.select("class_id", "n"), "class_id").withColumnRenamed("class_id", "id")
    rows = met.select("id", "band", "key", "part", F.explode(tiles).alias("tile")).join(items, "id").select("band", "key", "tile.low", "tile.high", "part", "id", "n", "bands")
    return written(rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(meet, "a long, b long, least long"))


def _compared(met: DataFrame, size: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b, overlap, least): those of the pairs (a, b, least) that are near by Jaccard.

    Long texts of few different words share bands without being near. So large sets are first compared by how many of their hashes fall into each of some buckets, which bounds what two sets
    share: no near pair is left out. The others are compared in full, by tiles of sets that reach each other.
    """
    heavy = written(met.filter(F.col("least") >= SKETCHED).select("a", "b"))
    ids = written(heavy.select(F.explode(F.array("a", "b")).alias("class_id")).distinct())
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(-(-ids.count() // SKETCHES) or 1))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("letters"):
                s = shingle_set(x.as_py(), width)
                counts = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                found.append(np.int64(len(s)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(found, pa.binary())], names=["class_id", "item"])

    def may_be_near(held: dict[int, tuple[int, np.ndarray, bool]], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        good = np.zeros(len(a), bool)
        for c, (x, y) in enumerate((held[i], held[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)):
            most = int(np.minimum(x[1], y[1]).sum(dtype=np.int64))
            good[c] = (x[2] and y[2]) or _near(most, x[0] + y[0] - most, x[0], percent, "jaccard")
        return a[good], b[good]

    def sketch(item: bytes) -> tuple[int, np.ndarray, bool]:
        counts = np.frombuffer(item, np.uint8, offset=8)
        return int(np.frombuffer(item, np.int64, 1)[0]), counts, bool(counts.max() == 255)

    dealt = heavy.select(F.least(block("a"), block("b")).alias("low"), F.greatest(block("a"), block("b")).alias("high"), "a", "b")
    sketched = texts.join(ids, "class_id", "left_semi").mapInArrow(sketches, "class_id long, item binary")
    met = written(met.filter(F.col("least") < SKETCHED).select("a", "b").unionByName(_in_tiles(dealt, ["low", "high"], sketched, sketch, dict, may_be_near, [])))

    # sets that reach each other are dealt into as many blocks as their shingles need, mostly one
    sized = components(met).join(size.select(F.col("class_id").alias("id"), "n"), "id")
    placed = written(sized.join(sized.groupBy("root").agg(F.ceil(F.sum("n") / TILE_SHINGLES).alias("blocks")), "root").select("id", "root", F.pmod(F.xxhash64("id"), "blocks").alias("block")))
    one, two = (placed.select(F.col("id").alias(c), *own, F.col("block").alias(f"block_{c}")) for c, own in (("a", ["root"]), ("b", [])))
    tiled = written(met.join(one, "a").join(two, "b").select("root", F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high"), "a", "b"))

    def coded(held: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """The sets as places in all hashes of the tile, and a mark for each of these."""
        hashes, places = np.unique(np.concatenate(list(held.values())), return_inverse=True)
        return dict(zip(held, np.split(places, np.cumsum([len(s) for s in held.values()])[:-1]), strict=True)), np.zeros(len(hashes), bool)

    def shared(tile: tuple[dict[int, np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        sets, marked = tile
        last, both, na, nb = None, *np.zeros((3, len(a)), np.int64)
        for c, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if j != last:  # pairs with one b follow each other
                marked[:] = False
                marked[sets[j]] = True
                last = j
            both[c], na[c], nb[c] = np.count_nonzero(marked[sets[i]]), len(sets[i]), len(sets[j])
        good = _near(both, na + nb - both, na, percent, "jaccard")
        return a[good], b[good], both[good], na[good]

    return _in_tiles(tiled, ["root", "low", "high"], texts.withColumnRenamed("letters", "item"), lambda text: shingle_set(text, width), coded, shared, ["overlap", "least"])


def _in_tiles(tiled: DataFrame, tile: list[str], items: DataFrame, made: Callable, ready: Callable, judged: Callable, names: list[str]) -> DataFrame:
    """(a, b, names) of the pairs (a, b, tile) whose items (class_id, item) are judged to go on, with the numbers that come out.

    An item travels once for each tile it is in, not for each pair, and is made once there; a task holds the items of one tile, made ready together.
    """
    each = tiled.select(*tile, F.explode(F.array("a", "b")).alias("class_id")).distinct().join(items, "class_id").select(*tile, F.col("class_id").alias("a"), F.lit(None).cast("long").alias("b"), "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, whole, at = {}, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, found = batch.column("item"), []
            is_item, a, b = batch.column("b").is_null().to_numpy(zero_copy_only=False), batch.column("a").to_numpy(), pc.fill_null(batch.column("b"), 0).to_numpy()
            keys = np.stack([batch.column(c).to_numpy() for c in tile], axis=1)
            begins = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))).nonzero()[0].tolist()
            for begin, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                if (here := tuple(keys[begin].tolist())) != at:
                    held, whole, at = {}, None, here
                pairs = begin + int(np.count_nonzero(is_item[begin:end]))  # a tile's items come first
                for row in range(begin, pairs):
                    held[int(a[row])] = made(of[row].as_py())
                if pairs < end:
                    whole = ready(held) if whole is None else whole
                    found.append(judged(whole, a[pairs:end], b[pairs:end]))
            columns = [np.concatenate(v) for v in zip(*found, strict=True)] if found else [[]] * (2 + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["a", "b", *names])

    rows = each.unionByName(tiled.withColumn("item", F.lit(None).cast(items.schema["item"].dataType)))
    return rows.repartition(*tile).sortWithinPartitions(*tile, F.col("b").asc_nulls_first(), "a").mapInArrow(compare, ", ".join(f"{c} long" for c in ("a", "b", *names)))


def components(pairs: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root): the smallest id that each paired id reaches, by rounds of minimum labels with pointer jumping."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    for _ in range(most_rounds):
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("m"))
        low = label.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"))
        up = label.select(F.col("id").alias("r"), F.col("root").alias("up"))
        jumped = written(low.join(up, F.col("root") == F.col("r"), "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root")))
        same = jumped.join(label.withColumnRenamed("root", "was"), "id").filter("root <> was").limit(1).count() == 0
        label = jumped
        if same:
            return label
    raise RuntimeError("components still change")


def near_duplicates(docs: DataFrame, id_column: str, text_column: str, percent: int = 82, width: int = 5, metric: str = "overlap", approximate: bool = False, most: int = 100_000) -> DataFrame:
    """(leader, chosen): what stays when documents are read in id order, each near one kept before replacing it if longer.

    leader is the id whose place a kept document has, chosen the document that stands there. Documents of different components are
    never near. A class that is near no other one needs no order: its first document leads, and the first of its longest is chosen,
    by aggregation, however many copies it has. In components of several classes the order is followed, on ids, lengths and the
    links between classes; no text or set of shingles reaches that step. Components of up to ``most`` documents and links do so in a group each, larger ones
    in rounds (follow_in_rounds), so that no task grows with a component. approximate: pairs by minhash_pairs().
    """
    if approximate:
        members, found = _minhash_classes(docs, id_column, F.col(text_column), percent, width)
    else:
        members, sets = shingle_classes(docs, id_column, F.col(text_column), width)
        found = _near_pairs(sets, percent, metric, width, _ranges(members))
    pairs = written(found.select("a", "b"))
    rooted = components(pairs)
    links = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    placed = written(members.join(rooted.select(F.col("id").alias("class_id"), "root"), "class_id", "left"))
    lone = placed.filter("root is null").groupBy("class_id").agg(F.min("id").alias("leader"), F.min(F.struct((-F.col("chars")).alias("n"), "id")).alias("x")).select("leader", F.col("x.id").alias("chosen"))
    sizes = placed.filter("root is not null").groupBy("root").agg(F.count("*").alias("n"))
    weights = links.join(rooted, F.col("a") == F.col("id")).groupBy("root").agg(F.count("*").alias("m"))
    large = written(sizes.join(weights, "root").filter(F.col("n") + F.col("m") > most).select("root"))
    # a class's links travel once, with its first document
    small = placed.filter("root is not null").join(large, "root", "left_anti")
    near = links.join(rooted.join(large, "root", "left_anti"), F.col("a") == F.col("id")).groupBy("a").agg(F.collect_set("b").alias("near"))
    mixed = small.join(near, (F.col("class_id") == F.col("a")) & (F.col("id") == F.col("class_id")), "left").select("root", "id", "class_id", "chars", "near")
    several = mixed.repartition("root").sortWithinPartitions("root", "id").mapInPandas(_follow_each, "leader long, chosen long")
    if large.limit(1).count():
        several = several.unionByName(follow_in_rounds(placed.join(large, "root").select("root", "id", "class_id", "chars"), links))
    empty = docs.select(F.col(id_column).cast("long").alias("leader")).join(members.select(F.col("id").alias("leader")), "leader", "left_anti")
    return lone.unionByName(several).unionByName(empty.withColumn("chosen", F.col("leader")))


#: Documents and links of a component that a round of follow_in_rounds() follows in one task; ranges of ids at most, which rounds are made of.
ROUND, RANGES = 1 << 21, 1000


def follow_in_rounds(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(leader, chosen) of documents (id, class_id, chars, root) whose classes have links (a, b, both ways), as if read in id order; without root they are one component.

    A round follows the next ids of every component, as many as have ``ROUND`` links with each other and with earlier ones. What it needs of the earlier ones is the entries that stand at a
    class near its own, which are far fewer: a link to a class where nothing stands is left out before. So a task holds no more than a round's share however large a component is,
    every link is read in one round, and the number of rounds is that of a component's links by ``ROUND``, whatever the chains of decisions are.
    """
    if "root" not in rows.columns:
        rows = rows.withColumn("root", F.lit(0).cast("long"))
    ranges = min(RANGES, 1 + 8 * (rows.count() + links.count()) // ROUND)
    ordered = rows.select("root", "id", "class_id", F.col("chars").cast("long").alias("chars")).repartitionByRange(ranges, "root", "id").sortWithinPartitions("root", "id")
    ranged = written(ordered.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))  # ids may occur twice, places do not
    classes = written(ranged.select("root", "class_id", "range").distinct())
    first = classes.groupBy(F.col("class_id").alias("b")).agg(F.min("range").alias("first"))
    before = written(links.select("a", "b").join(classes.withColumnRenamed("class_id", "a"), "a").join(first, "b").filter("first <= range").select("root", "range", "a", "b"))
    weight = ranged.select("root", "range").unionByName(before.select("root", "range")).groupBy("root", "range").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(W.partitionBy("root").orderBy("range")) - F.col("n")
    rounds = written(weight.select("root", "range", F.floor(so_far / ROUND).alias("round")))
    numbers = [r["round"] for r in rounds.select("round").distinct().orderBy("round").collect()]
    dealt, linked = (written(df.join(rounds, ["root", "range"]).drop("range").repartition("root", "round"), by=["round"]) for df in (ranged, before))
    entry = ["root", "place", "leader", "chosen", "class_id", "chars"]
    stands = rows.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in entry))
    for r in numbers:
        docs, near = dealt.filter(F.col("round") == r), linked.filter(F.col("round") == r)
        own = docs.select("class_id")
        touched = stands.join(near.select(F.col("b").alias("class_id")).unionByName(own).distinct(), "class_id", "left_semi")
        useful = near.join(stands.select("class_id").unionByName(own).distinct().withColumnRenamed("class_id", "b"), "b", "left_semi").select("root", "a", "b")
        items = docs.select("root", "place", F.col("id").alias("leader"), F.col("id").alias("chosen"), "class_id", "chars", F.lit(True).alias("fresh")).unionByName(touched.select(*entry, F.lit(False).alias("fresh")))
        done = written(items.groupBy("root").cogroup(useful.groupBy("root")).applyInPandas(_follow_on, stands.schema))
        stands = written(stands.join(done.select("place"), "place", "left_anti").select(*entry).unionByName(done))
    return stands.select("leader", "chosen")


def _follow_on(items: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """The entries (root, place, leader, chosen, class_id, chars) of a component after its fresh documents, named by their own ids so far, were read in order."""
    fresh = items["fresh"].to_numpy(bool)
    entries = {x[0]: list(x) for x in items[~fresh][["place", "leader", "chosen", "class_id", "chars"]].itertuples(index=False)}
    standing: dict[int, set[int]] = {}
    for place, _, _, kind, _ in entries.values():
        standing.setdefault(kind, set()).add(place)
    links = links.sort_values("a")
    near, kinds = links["b"].to_numpy(), links["a"].to_numpy()
    docs = items[fresh].sort_values("place")
    begins, ends = (np.searchsorted(kinds, docs["class_id"].to_numpy(), side).tolist() for side in ("left", "right"))
    for place, doc, kind, chars, begin, end in zip(*(docs[c].tolist() for c in ("place", "chosen", "class_id", "chars")), begins, ends, strict=True):
        found = [e for c in {kind, *near[begin:end].tolist()} if c in standing for e in standing[c]]
        if not found:
            standing.setdefault(kind, set()).add(place)
            entries[place] = [place, doc, doc, kind, chars]
        elif chars > (entry := entries[min(found)])[4]:
            standing[entry[3]].discard(entry[0])
            standing.setdefault(kind, set()).add(entry[0])
            entry[2:] = doc, kind, chars
    out = pd.DataFrame(list(entries.values()), columns=["place", "leader", "chosen", "class_id", "chars"])
    out.insert(0, "root", items["root"].iloc[0] if len(items) else 0)
    return out


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """One component in id order. An entry is kept at its leader's place; ``standing`` has the entries at which a class stands now."""
    rows = rows.sort_values("id", kind="stable")
    near = {c: set(n) for c, n in zip(rows["class_id"], rows["near"], strict=True) if n is not None}
    leaders: list[int] = []
    stands: list[tuple[int, int, int]] = []  # of each entry: chosen id, its class, its length
    standing: dict[int, set[int]] = {}
    for doc, kind, chars in zip(rows["id"].tolist(), rows["class_id"].tolist(), rows["chars"].tolist(), strict=True):
        found = [e for c in (kind, *near.get(kind, ())) for e in standing.get(c, ())]
        if not found:
            standing.setdefault(kind, set()).add(len(leaders))
            leaders.append(doc)
            stands.append((doc, kind, chars))
        elif chars > stands[entry := min(found)][2]:
            standing[stands[entry][1]].discard(entry)
            standing.setdefault(kind, set()).add(entry)
            stands[entry] = (doc, kind, chars)
    return pd.DataFrame({"leader": leaders, "chosen": [s[0] for s in stands]})


def _follow_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components in order of their root: what is complete is followed together, as components share no class; the last one waits for its other rows."""
    waiting: list[pd.DataFrame] = []
    for rows in batches:
        last = rows["root"].to_numpy() == rows["root"].iloc[-1] if len(rows) else np.zeros(0, bool)
        if last.all() and waiting and len(rows) and waiting[-1]["root"].iloc[-1] == rows["root"].iloc[-1]:
            waiting.append(rows)
            continue
        if len(rows):
            yield _follow(pd.concat([*waiting, rows[~last]]))
            waiting = [rows[last]]
    if waiting:
        yield _follow(pd.concat(waiting))
