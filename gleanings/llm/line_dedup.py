"""Line dedup over all documents by a deletion-neighbourhood join, with DataFrame functions only.

The unit of an edit is a word: two lines are near if one word is inserted, deleted or replaced. Each line emits a hashed key for
itself and for every deletion of one word; equal keys meet in a join. A key is the XOR of one hash for each (word, place), so all
keys of a line follow from running XORs; long lines are cut into blocks of words for that, so that the work stays linear. Two deletions of the same place meet for a replacement; a deletion meets a whole line for
an insertion. The word lists of all that met are then compared, and a line goes if an earlier line is near or equal: earlier by document
id, then by a hash of the text, then by line number.

One word is little of a long line and all of a short one. So the bound follows the length: a pair is near by one edit only if its longer
line has at least ``near_words`` words, and shorter lines go only if they are equal to an earlier one. With 10, as op3 has it, near
lines agree in 90 % of their words at least; the default of 1 applies the edit to lines of every length.

Before the neighbourhood is emitted, lines without any possible partner are set aside exactly: one edit cannot touch both the
first and the last L words of a line that has more than 2 L, so a partner shares one of these two; L is the largest power of two that fits.
Equal lines are one before the join. Keys are aggregated with map-side combine and joined back, so hot keys are never gathered.

Defined results: white space is collapsed and trimmed for comparison only; blank lines always stay and count as no line; null texts
stay null; documents with a null id are left as they are; rows with the same id and text are one document and lose the same lines;
rows with the same id and different texts are different documents; what is left of a text keeps its lines as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanings.llm.common import SPACE, staged


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no (from 0) and norm, the line with white space collapsed and trimmed; blank lines left out."""
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "text_hash", "line_no", _norm(F.col("line")).alias("norm")).filter("norm <> ''")


def _norm(line: Column) -> Column:
    # single spaces only is the common case, and needs no pattern
    odd = F.contains(line, F.lit("  "))
    for space in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(space))
    return F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))


#: One boolean for each line up to the last of the sorted numbers g: whether it is among them.
_FLAGS = "flatten(transform(g, (x, k) -> concat(array_repeat(false, x - if(k = 0, 0, g[k - 1] + 1)), array(true))))"
#: The lines of a text without those, and those alone at their places. The flags are made once a row, outside the inner lambda.
_WITHOUT = f"element_at(transform(array({_FLAGS}), f -> array_join(filter(split(text, '\n'), (x, i) -> not coalesce(get(f, i), false)), '\n')), 1)"
_ALONE = f"element_at(transform(array({_FLAGS}), f -> transform(split(text, '\n'), (x, i) -> if(coalesce(get(f, i), false), x, ''))), 1)"

#: Length of the first and last words by which partners are found, for lines of n words: the largest power of two up to (n - 1) / 2.
_REACH = "cast(case when {n} >= 3 then pow(2, length(bin((({n}) - 1) div 2)) - 1) else 0 end as int)"

BLOCK = 64
#: (b, before, after, whole) of every block of a long line: the running XORs of the words before the block, at their own places, and of those
#: from it on, at one place less, and that of the line itself.
_LONG = f"""
aggregate(
  sequence(0, cast((n - 1) div {BLOCK} as int)),
  named_struct('out', cast(array() as array<struct<b: int, before: bigint, passed: bigint>>), 'own', 0L, 'shifted', 0L),
  (s, b) -> named_struct(
    'out', concat(s.out, array(named_struct('b', b, 'before', s.own, 'passed', s.shifted))),
    'own', s.own ^ aggregate(slice(w, b * {BLOCK} + 1, {BLOCK}), named_struct('j', b * {BLOCK}, 'x', 0L), (t, y) -> named_struct('j', t.j + 1, 'x', t.x ^ xxhash64(y, t.j)), t -> t.x),
    'shifted', s.shifted ^ aggregate(slice(w, b * {BLOCK} + 1, {BLOCK}), named_struct('j', b * {BLOCK} - 1, 'x', 0L), (t, y) -> named_struct('j', t.j + 1, 'x', t.x ^ xxhash64(y, t.j)), t -> t.x)),
  s -> transform(s.out, o -> named_struct('b', o.b, 'before', o.before, 'after', s.shifted ^ o.passed, 'whole', s.own)))
"""
_BLOCKS = f"if(n <= {BLOCK}, array(named_struct('b', 0, 'before', 0L, 'after', cast(null as bigint), 'whole', cast(null as bigint))), {_LONG})"
#: Keys of a block's line without each of the block's words, from the hashes of its words at their own places and at one less.
_DELETIONS = """
aggregate(
  sequence(0, size(own) - 1),
  named_struct('keys', cast(array() as array<bigint>), 'before', before, 'after', after),
  (s, i) -> named_struct('keys', concat(s.keys, array(s.before ^ s.after ^ shifted[i])), 'before', s.before ^ own[i], 'after', s.after ^ shifted[i]),
  s -> s.keys)
"""

#: Word lists w and v are at most one edit apart: after their common beginning, the rest agrees beside one word.
_COMMON = "cast(coalesce(array_position(zip_with(w, v, (x, y) -> not (x <=> y)), true), 1 + greatest(size(w), size(v))) as int)"
_VERIFIED = """
case when size(w) = size(v) then slice(w, c + 1, greatest(size(w) - c, 0)) = slice(v, c + 1, greatest(size(v) - c, 0))
     when size(w) = size(v) + 1 then slice(w, c + 1, greatest(size(w) - c, 0)) = slice(v, c, greatest(size(v) - c + 1, 0))
     when size(v) = size(w) + 1 then slice(v, c + 1, greatest(size(v) - c, 0)) = slice(w, c, greatest(size(w) - c + 1, 0))
     else false end
"""


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line's hashes, place, number of words and the hashes of its first and last words, for both lengths a partner may use."""
    rows = lines(docs).withColumn("n", F.expr("length(norm) - length(replace(norm, ' ', '')) + 1"))
    rows = rows.withColumn("k1", F.expr(_REACH.format(n="n"))).withColumn("k2", F.expr(_REACH.format(n="n + 1")))
    anchor = "case when {k} > 0{more} then xxhash64('{side}', {k}, substring_index(norm, ' ', {sign}{k})) end"
    return rows.select(
        F.expr("xxhash64(norm)").alias("h1"),
        F.expr("xxhash64('again', norm)").alias("h2"),
        "doc_id",
        "text_hash",
        "line_no",
        "n",
        *[F.expr(anchor.format(k=k, side=side, sign=sign, more=" and k2 <> k1" if k == "k2" else "")).alias(f"{side}_{k}") for side, sign in (("head", ""), ("tail", "-")) for k in ("k1", "k2")],
    )


def _keys(words: DataFrame, near_words: int) -> DataFrame:
    """pos, n, i and key: one row for each deletion of a word, and one (i = -1) for the line itself; n is the number of words left."""
    blocks = words.select("pos", "n", "w", F.explode(F.expr(_BLOCKS)).alias("o")).select("pos", "n", "o.*", F.expr(f"slice(w, o.b * {BLOCK} + 1, {BLOCK})").alias("w"))
    hashed = blocks.withColumns({"own": F.expr(f"transform(w, (y, k) -> xxhash64(y, b * {BLOCK} + k))"), "shifted": F.expr(f"transform(w, (y, k) -> xxhash64(y, b * {BLOCK} + k - 1))")})
    summed = hashed.select("pos", "n", "b", "before", "own", "shifted", F.expr("coalesce(after, aggregate(shifted, 0L, (s, x) -> s ^ x))").alias("after"), F.expr("coalesce(whole, aggregate(own, 0L, (s, x) -> s ^ x))").alias("whole"))
    line = F.expr("if(b = 0, array(named_struct('i', -1, 'n', n, 'key', whole)), array())")
    deletions = F.expr(f"if(n < {near_words}, array(), transform({_DELETIONS}, (x, k) -> named_struct('i', b * {BLOCK} + k, 'n', n - 1, 'key', x)))")
    return summed.select("pos", F.explode(F.concat(line, deletions)).alias("k")).select("pos", "k.i", F.xxhash64("k.key", "k.n").alias("key"))


def near_lines(docs: DataFrame, seen: DataFrame, near_words: int = 1) -> DataFrame:
    """pos (doc_id, text_hash, line_no) of each distinct line (its first place) that has an earlier near line, from occurrences(docs)."""
    seen = seen.filter(F.col("n") >= near_words - 1)  # the shorter line of a pair may have one word less
    anchors = ["head_k1", "head_k2", "tail_k1", "tail_k2"]
    distinct = staged(seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("pos"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in anchors]).drop("h1", "h2"))
    marks = distinct.select("pos", F.explode(F.array_compact(F.array(*anchors))).alias("anchor"))
    # written out, so that the join deals out both sides anew and Spark can split a hot key; so below
    shared = staged(marks.groupBy("anchor").count().filter("count > 1").select("anchor"))
    hopeful = marks.join(shared, "anchor").select("pos").unionByName(distinct.filter("n < 3").select("pos")).distinct()
    wanted = hopeful.groupBy(F.col("pos.doc_id").alias("_d"), F.col("pos.text_hash").alias("_h")).agg(F.array_sort(F.collect_set("pos.line_no")).alias("g"))
    # the words of those lines, read from the texts again
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    held = rows.join(wanted, (F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_h"))).select("doc_id", "text_hash", F.posexplode(F.expr(_ALONE)).alias("line_no", "line"))
    held = held.filter("line <> ''").select(F.struct("doc_id", "text_hash", "line_no").alias("pos"), F.split(_norm(F.col("line")), " ").alias("w"))
    words = staged(held).withColumn("n", F.size("w"))

    # what meets has a deletion of its longer line on one side at least, so the bound on the length holds for all that meets
    keyed = _keys(words, near_words)
    met_keys = staged(keyed.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"))
    close = staged(keyed.join(met_keys, "key"))
    earliest = close.filter("i >= 0").groupBy("key", "i").agg(F.min("pos").alias("m"), F.max("pos").alias("x")).filter("m <> x").drop("x")
    replaced = close.join(earliest, ["key", "i"]).filter("m < pos").select("pos", "m")
    whole = close.filter("i < 0").select(F.col("pos").alias("p"), "key").distinct()  # copies of a row would otherwise meet each other's
    inserted = close.filter("i >= 0").join(whole, "key").select(F.greatest("pos", "p").alias("pos"), F.least("pos", "p").alias("m"))
    met = replaced.unionByName(inserted).distinct()
    both = met.join(words.select("pos", "w"), "pos").join(words.select(F.col("pos").alias("m"), F.col("w").alias("v")), "m")
    return both.withColumn("c", F.expr(_COMMON)).filter(_VERIFIED).select("pos").distinct()


def removed_lines(docs: DataFrame, near_words: int = 1) -> DataFrame:
    """doc_id, text_hash and g (sorted numbers of the lines to remove), one row for each document that loses lines."""
    seen = staged(occurrences(docs))
    near = near_lines(docs, seen, near_words).select(F.col("pos").alias("p"))
    firsts = seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("pos"), F.count("*").alias("times"))
    judged = firsts.join(near, F.col("pos") == F.col("p"), "left").withColumn("near", F.col("p").isNotNull())
    wanted = staged(judged.filter("near or times > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "pos", "near"))
    gone = seen.join(wanted, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(F.col("near") | (F.struct("doc_id", "text_hash", "line_no") != F.col("pos")))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("g"))


def dedup_lines(docs: DataFrame, near_words: int = 1) -> DataFrame:
    """doc_id, text (without repeated and near lines), n_lines (that are not blank) and n_removed of every row of docs."""
    gone = removed_lines(docs, near_words).withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = rows.join(gone, (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left")
    return joined.select(
        "doc_id",
        F.expr(f"case when g is null then text else {_WITHOUT} end").alias("text"),
        F.expr("greatest(0L, coalesce(cast(size(filter(split(text, '\n'), x -> btrim(x, ' \\t\\r\\u000b\\u000c') <> '')) as bigint), 0L))").alias("n_lines"),
        F.coalesce(F.size("g").cast("long"), F.lit(0).cast("long")).alias("n_removed"),
    ).withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
