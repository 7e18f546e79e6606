"""SimHash near-dedup with a segment-popcount embedding.

A fingerprint is 64 bits; two are linked if they differ in at most 3. The search maps fingerprints to bit counts of segments: the
Manhattan distance of two such vectors is at most the number of differing bits, so it bounds the distance from below.

Of two linked fingerprints, one half (32 bits) differs in at most one bit. A half is embedded as the bit counts of its 16 segments of
two bits, and the grid has unit cells: linked fingerprints have a half whose vectors are at Manhattan distance 0 or 1. Every
fingerprint stands in its own cell of each half; where its bit count is odd it also probes the cells at distance 1. Two vectors at
distance 1 have sums of different parity, so each such pair is met exactly by its odd member, and none is met twice in a half.
What meets in a cell is verified exactly on all 64 bits.

Texts with the same fingerprint become one node before the search, so groups of copies cost nothing in it. A cell with very many
members is split like any skewed join key; only verified links leave the join.

Three bits of a fingerprint tell texts that are almost equal; a similarity of 0.8 changes far more of them, and cells that would still meet are too wide to
be searched. So dedup_similar(), which finds texts of a given similarity, takes the groups of this search as one kind of candidates and adds bands of
MinHash minima as another; all candidates are compared in full on their shingles.

Defined results: A-Z are lower-cased; null counts as empty; a text without words has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle. Repeated rows share a component. A component's id is its smallest doc_id; a null
doc_id is smallest of none (a component with only null ids has a null id). Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanings.llm.common import KEYS, one_row_each, per_batch, small_batches, staged, texts, with_keys
from gleanings.llm.components import connected_components


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included: a bit is set if over half of the shingle hashes have it."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    xxh = xxhash.xxh64_intdigest
    if len(words) < width:
        return xxh(b" ".join(words), seed)
    hashes = np.array([xxh(s, seed) for s in map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))], dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(octets), 255):  # sums of so many bits fit in a byte
        total += np.add.reduce(np.unpackbits(octets[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    bits = total * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, also: list[str] = ()) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of docs (doc_id, text), and the long columns that ``also`` names."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, width, seed) for t in texts(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names=["doc_id", "fp", *also])

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also), run, ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in also]]))


def near_links(fps: DataFrame, most: int = 3) -> DataFrame:
    """fps (fp, distinct) -> links (a, b) of fingerprints at most 3 bits apart, each found at least once."""
    if not 0 <= most <= 3:
        raise ValueError("halves at distance 1 are guaranteed up to 3 differing bits only")
    half = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.expr("fp & 4294967295L").alias("bits")), F.struct(F.lit(1).alias("side"), F.expr("shiftrightunsigned(fp, 32)").alias("bits")))).alias("h")
    halves = fps.select("fp", half).select("fp", "h.side", F.expr("h.bits - (shiftrightunsigned(h.bits, 1) & 1431655765L)").alias("cell"))  # bit counts, two bits each
    home = halves.select("side", "cell", "fp")
    step = lambda i: f"array(if((shiftrightunsigned(cell, {2 * i}) & 3) < 2, cell + {1 << (2 * i)}L, null), if((shiftrightunsigned(cell, {2 * i}) & 3) > 0, cell - {1 << (2 * i)}L, null))"
    around = F.expr(f"array_compact(flatten(array({', '.join(step(i) for i in range(16))})))")
    odd = "bit_count(cell & 1431655765L) % 2 = 1"  # a count of 2 does not change parity
    probes = halves.filter(odd).select("side", F.explode(around).alias("cell"), "fp", F.lit(True).alias("probe"))
    left = probes.unionByName(home.withColumn("probe", F.lit(False))).withColumnRenamed("fp", "a")
    met = left.join(home.withColumnRenamed("fp", "b"), ["side", "cell"]).filter(F.expr(f"a <> b and (probe or a < b) and bit_count(a ^ b) <= {most}"))
    return met.select("a", "b")


def near_groups(docs: DataFrame, width: int = 3, seed: int = 42, most: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of docs."""
    return _grouped(staged(fingerprints(docs, width, seed)), most).select("doc_id", "fp", "component_id")


def _grouped(rows: DataFrame, most: int) -> DataFrame:
    """rows (doc_id, fp and others) with component_id, and root: the smallest fingerprint of the component."""
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(near_links(nodes.select("fp"), most))
    roots = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(named, "root").select(F.col("fp").alias("f"), "component_id", "root")
    return rows.join(classes, F.col("fp") == F.col("f")).drop("f")


def dedup(docs: DataFrame, width: int = 3, seed: int = 42, most: int = 3) -> DataFrame:
    """Of each component the row with the smallest id (null last), with all its columns; of rows with the same id one stays."""
    rows = _grouped(staged(fingerprints(with_keys(docs), width, seed, KEYS)), most)
    return one_row_each(docs, _first_rows(rows))


def _first_rows(rows: DataFrame) -> DataFrame:
    """KEYS of the first row of each root: the smallest id, null last."""
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *KEYS)).alias("x"))
    return first.select(*[F.col(f"x.{k}").alias(k) for k in KEYS])


#: Bands of a text in the search for similar texts, and minima of a band.
BANDS, MINIMA = 20, 8


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of a text's word shingles, repeats included; fewer words make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    xxh = xxhash.xxh64_intdigest
    return np.array([xxh(s, seed) for s in map(b" ".join, zip(*[words[i:] for i in range(min(width, len(words)))], strict=False))], dtype="<u8")


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles: each from the minima of MINIMA permutations. Two sets of similarity s share one with chance 1 - (1 - s^8)^20."""
    random = np.random.default_rng(17)
    times, plus = random.integers(1, 2**63, BANDS * MINIMA, np.uint64) | np.uint64(1), random.integers(0, 2**63, BANDS * MINIMA, np.uint64)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(hashes), 1024):  # memory stays bounded however long the text is
        x = hashes[begin : begin + 1024, None] * times + plus
        x ^= x >> np.uint64(31)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    mixed = least.reshape(BANDS, MINIMA) * (times[:MINIMA] + plus[:MINIMA])
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xD6E8FEB86659FD93)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and s, its distinct shingles, of wanted nodes (node, KEYS of a row of docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts(batch.column(len(KEYS)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEYS)], pa.array(sets, pa.list_(pa.int64()))], names=[*KEYS, "s"])

    small_batches(docs.sparkSession)
    found = with_keys(one_row_each(docs, wanted)).select(*KEYS, "text").mapInArrow(run, ", ".join([*[f"{k} long" for k in KEYS], "s array<long>"]))
    return found.join(wanted, KEYS).select("node", "s")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets have a Jaccard similarity of percent / 100 at least, by a full comparison."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared * 100 >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _between_groups(rows: DataFrame, keys: list[str], own: str | None = None, other: str | None = None) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that share all keys; rows (keys, node, root), root names the group.

    With own and other, two further columns, a node meets those whose ``own`` is its ``other`` and the other way round. Of the largest group under a key no two
    meet, so it may be as large as it likes.
    """
    sides = [own, other] if own else []
    of_roots = rows.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    mixed = of_roots.groupBy(*keys).agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("x")).filter("roots > 1").select(*keys, F.col("x.root").alias("largest"))
    held = staged(rows.join(mixed, keys))
    left = held.filter("root <> largest").select(*keys, *sides, F.col("node").alias("x"), F.col("root").alias("rx"))
    right = held.select(*keys, *[F.col(c).alias(as_) for c, as_ in zip(sides, reversed(sides), strict=True)], F.col("node").alias("y"), F.col("root").alias("ry"))
    return left.join(right, keys + sides).filter("rx <> ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


#: Size classes of a factor e.
CLASSES = 50


def _rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """t, small, large, own, other and node: keys of which any two sets (node, s) of a Jaccard similarity of percent / 100 share one at least, where
    ``own`` of each is ``other`` of its partner.

    A set's shingles are put in order, those that fewest of the sets have first. Two sets that share k shingles, k as their sizes ask for, share one of
    their first (size - k + 1). Partners are told apart by classes of sizes two hundredths wide, as k grows with the partner: a text that differs from all
    others in too many places has only shingles of its own in front, and meets nobody.
    """
    each = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("t"))
    counted = each.join(each.groupBy("t").agg(F.count("*").alias("df")), "t")
    first = F.expr(f"n - cast(ceil(n * {percent} / 100 - 1e-9) as int) + 1")
    ordered = counted.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    ranked = ordered.select("node", "n", F.posexplode(F.slice("o", F.lit(1), first)).alias("at", "x")).filter("x.df > 1").select("node", "n", "at", "x.t")
    of = lambda size: F.floor(F.log(size) * CLASSES + 1e-9).cast("int")
    shared = lambda k: F.ceil((F.col("n") + F.ceil(F.exp(k / CLASSES) * (1 - 1e-9))) * percent / (100 + percent) - 1e-9)
    others = F.sequence(of(F.col("n") * percent / 100 * (1 - 1e-9)), of(F.col("n") * 100 / percent * (1 + 1e-9)))
    met = ranked.select("node", "t", of(F.col("n")).alias("own"), F.explode(F.filter(others, lambda k: F.col("at") <= F.col("n") - shared(k))).alias("other"))
    return met.select("t", F.least("own", "other").alias("small"), F.greatest("own", "other").alias("large"), "own", "other", "node")


#: Up to so many nodes of a bucket meet as they are; of larger buckets those that share a rare shingle. Both ways find the same links.
FEW = 32


def similar_links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes (node, fp, bands, KEYS of a row of docs) whose texts have a Jaccard similarity of percent / 100 at least, on distinct shingles.

    Nodes meet in buckets: those of a component of linked fingerprints (near_links) make one, and those that share a band. Every link is compared in full.
    First each node of a bucket meets its hub, the one that shares buckets with most others, and what these verified links hold together is a group; a large
    group of near copies thus makes a star and not all of its pairs. Then, in buckets with nodes of several groups, nodes of different groups meet: in buckets
    of FEW nodes all of them, and the nodes of larger ones by their rare shingles (_rare_keys), which misses no link. So the groups that come out are those of
    all similar pairs that share a bucket; only links within a group that is already held together are left out.
    """
    linked = connected_components(near_links(nodes.select("fp").distinct()))
    by_print = nodes.join(linked, F.col("fp") == linked["node"], "left").select(F.lit(-1).alias("band"), F.coalesce("root", "fp").alias("key"), nodes["node"])
    by_band = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    each = staged(by_band.unionByName(by_print).select("band", "key", "node"))
    several = each.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = staged(each.join(several, ["band", "key"]).select("band", "key", "node", "n"))
    reach = met.groupBy("node").agg(F.sum("n").alias("reach"))
    hubs = met.join(reach, "node").groupBy("band", "key").agg(F.max(F.struct("reach", "node")).alias("x")).select("band", "key", F.col("x.node").alias("hub"))
    sets = staged(_sets(docs, reach.join(nodes, "node").select("node", *KEYS), width))
    star = staged(_verified(met.join(hubs, ["band", "key"]).filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, percent))

    grouped = connected_components(star).withColumnRenamed("node", "m")
    rooted = staged(met.join(grouped, F.col("node") == F.col("m"), "left").select("band", "key", "node", "n", F.coalesce("root", "node").alias("root")))
    few = _between_groups(rooted.filter(F.col("n") <= FEW), ["band", "key"])
    mixed = rooted.filter(F.col("n") > FEW).groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band", "key")
    crowd = staged(rooted.join(mixed, ["band", "key"]).select("node", "root").distinct())
    many = _between_groups(staged(_rare_keys(sets.join(crowd.select("node"), "node"), percent).join(crowd, "node")), ["t", "small", "large"], "own", "other")
    return star.unionByName(_verified(few.unionByName(many).distinct(), sets, percent))


def exact_links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """All links of similar_links(), none missed: nodes meet by the rarest of their shingles. Its cost grows with how often shingles repeat."""
    from gleanings.operators.dedup import _near_pairs

    sets = staged(_sets(docs, nodes.select("node", *KEYS), width))
    return _near_pairs(sets.filter("size(s) > 0").withColumnRenamed("node", "class_id"), percent, "jaccard").select("a", "b")


def dedup_similar(docs: DataFrame, width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """Of each group of similar texts the row with the smallest id (null last), with all its columns; of rows with the same id one stays.

    Texts with the same set of shingles are one node; nodes are linked by similar_links(), or by exact_links(). Null and empty texts are one node. Very long
    texts count whole; of their shingles so many numbers of eight bytes are held at a time as they have words.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in texts(batch.column(1)):
            hashes = np.unique(shingle_hashes(t, width))
            rows.append((xxhash.xxh64_intdigest(hashes.tobytes(), 1), fingerprint(t, width), bands(hashes)))
        signed = lambda k: pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], signed(0), signed(1), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["doc_id", *KEYS, "node", "fp", "bands"])

    keyed = with_keys(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *KEYS)
    rows = staged(per_batch(keyed, run, ", ".join([*[f"{c} long" for c in ["doc_id", *KEYS, "node", "fp"]], "bands array<long>"])))
    # equal sets have equal bands, and fingerprints that differ with repeats only
    nodes = staged(rows.groupBy("node").agg(F.min(F.struct(*KEYS, "fp", "bands")).alias("x")).select("node", "x.*"))
    roots = connected_components((exact_links if exact else similar_links)(docs, nodes, width, percent))
    named = rows.select("doc_id", *KEYS, F.col("node").alias("n")).join(roots, F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("root", "n"))
    return one_row_each(docs, _first_rows(named))
