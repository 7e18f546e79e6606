"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source size times. The expected copies are summed along an order of the source's
documents, one random offset is added, and a document is emitted once for each integer that its share of the line crosses. The
order goes by size class, so that short and long documents are drawn in proportion and the words taken come near the target.

A source may hold any share of the rows: the running sum is taken in two steps, first over (source, size class, lane) totals, which
are few, then within such a group. A document's lane is a hash of its id (of its text where the id is null), one of ``lanes``, at every size
of the input. Sizes are counted once and written out; texts take no part in what follows.

There may be very many sources too: their order and the running sums over it are taken range by range, from the totals of all ranges.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; equal rows are
separate documents, and of rows with the same id the order is by size and a hash of the text; a source without words gets target 0;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.llm.common import KEYS, n_words, staged, with_keys


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows and, for each of sums, its total over the rows before, in an order without ties; no task gets more than a range of the rows."""
    ranged = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumns({f"_{k}": v for k, v in sums.items()}))
    whole = ranged.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_whole_{k}") for k in sums])
    # one row a range
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    begins = whole.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_whole_{k}").over(earlier), F.lit(0)).alias(f"_begin_{k}") for k in sums])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumns({f"_own_{k}": F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in sums}).join(begins, F.col("_range") == F.col("_r"))
    return summed.select(*rows.columns, *[(F.col(f"_begin_{k}") + F.col(f"_own_{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> and target. One row for each source in and out.

    Weights repeat along the sources in code-point order, null last. Targets are share of all sizes by weight; none is above most
    times its source's size, and the excess goes to the others by weight. With sources in order of cap / weight, those that reach
    their cap are a prefix, so the final level follows from running sums.
    """
    named = [F.col("source").isNull(), F.col("source")]
    placed = running(sizes.select("source", "source_size"), named, {"position": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).drop("position")
    summed = running(weighed, [F.col("cap") / F.col("weight"), *named], {"caps_before": F.col("cap"), "weight_before": F.col("weight")})
    # the level if exactly the sources before this one are at their cap; it rises as long as those do reach it, and falls from there on
    total, all_weights = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit((total or 0) * float(share)) - F.col("caps_before")) / (F.lit(all_weights or 0.0) - F.col("weight_before"))
    (final,) = summed.agg(F.max(level)).first()
    return summed.select("source", "source_size", F.least(F.col("cap"), F.lit(final).cast("double") * F.col("weight")).alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """The one random offset of a source in [0, 1): 32 bits of an MD5, the same in every run."""
    name = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}"), name).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, lanes: int = 1024, also: list[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (whole times the document is taken), one row for each row of docs.

    The columns that ``also`` names are passed on.
    """
    lane = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % lanes
    sized = staged(docs.select("doc_id", "source", n_words("text").alias("size"), lane.alias("lane"), F.xxhash64("text").alias("text_hash"), *also))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    laned = sized.withColumn("class", F.floor(F.sqrt("size")))
    groups = laned.groupBy("source", "class", "lane").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("class", "lane").rowsBetween(W.unboundedPreceding, -1)
    begins = groups.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    begins = begins.join(targets.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate")), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    within = W.partitionBy("source", "class", "lane").orderBy("doc_id", "size", "text_hash")
    ranked = laned.withColumn("rank", F.row_number().over(within))
    b = begins.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("lane").alias("l"), "begin", "source_size", "target", "rate")
    joined = ranked.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("lane") == F.col("l")))
    # copies expected up to and including this document, and up to the one before it
    line = lambda k: F.floor(offset_of(F.col("source"), seed) + F.col("rate") * k)
    k = F.col("begin") + F.col("rank")
    return joined.select("doc_id", "source", "size", "source_size", "target", (line(k) - line(k - 1)).alias("copies"), *also)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with all their columns, each as often as the mix takes it.

    Copies are joined back by id and text. Rows that agree in both share what the mix takes of them all: each gets as many, or one more.
    """
    keyed = with_keys(docs)
    taken = mix(keyed.select("doc_id", "source", "text", *KEYS), also=KEYS, **options)
    picked = staged(taken.groupBy(*KEYS).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows")).filter("_all > 0"))
    lone = keyed.join(picked.filter("_rows = 1"), KEYS).withColumn("_copies", F.col("_all"))
    # few, and sent along by Spark where they are
    several = keyed.join(picked.filter("_rows > 1"), KEYS).withColumn("_n", F.row_number().over(W.partitionBy(*KEYS).orderBy("source")))
    share = F.floor(F.col("_all") * F.col("_n") / F.col("_rows")) - F.floor(F.col("_all") * (F.col("_n") - 1) / F.col("_rows"))
    both = lone.select(*docs.columns, "_copies").unionByName(several.withColumn("_copies", share).filter("_copies > 0").select(*docs.columns, "_copies"))
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")
