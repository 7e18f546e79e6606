"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanings.llm import collocations, exact_dedup, language_model, line_dedup, merkle, mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, url_filter, warc
from gleanings.llm.common import checkpoint_dir
from gleanings.session import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page under five rules."""
    rules = spark.createDataFrame(
        [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")],
        "host string, path string, verdict string",
    )
    return url_filter.match_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
with rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
best as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
         from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from parts left join best using (page_id)
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from n window g as (partition by text_sha256)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from sized group by source),
capped as (select *, 2.0 * source_size as cap, 1.5 * sum(source_size) over () as total, sum(weight) over () as w from sources),
levels as (select *, (total - coalesce(sum(cap) over before, 0)) / (w - coalesce(sum(weight) over before, 0)) as level from capped
           window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
final as (select source, source_size, least(cap, weight * max(level) over ()) as target from levels),
ranked as (select *, row_number() over (partition by source order by floor(sqrt(size)), cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as bigint) % 1024, doc_id) as k from sized),
rated as (select r.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
          cast(('0x' || substr(md5('7' || coalesce('=' || r.source, 'null')), 1, 8)) as bigint) / 4294967296.0 as u
          from ranked r join final f on r.source is not distinct from f.source)
select doc_id, size, source_size, target, cast((floor(u + rate * k) - floor(u + rate * (k - 1))) * size as bigint) as taken from rated
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_chars left and the digest of what is left of every document."""
    found = substring_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars left and the digest of what is left of every document."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), near_words=10)
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, of every document."""
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), PIECES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document; a fifth of them by a hash of the id are tampered with."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", url_filter.UPPER, url_filter.LOWER)
    changed = merkle.leaf([lower if f == "text" else F.col(f) for f in merkle.FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0  # a null id is never hit
    found = merkle.proofs(merkle.build(docs, keep={"tampered": F.when(hit, changed)}))
    folded = merkle.folded(F.coalesce("tampered", "node"), F.col("path"))
    rows = found.select(F.col("order").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(base: str, key: str, levels: int) -> str:
    """CTEs base1, base2, ...: parents of sixteen nodes each, where a group has several."""
    up = lambda k: f"{base}{k} as (select {key}, place // 16 as place, (max(n) + 15) // 16 as n, sha256(string_agg(node, '' order by place)) as node from {base}{k - 1} where n > 1 group by {key}, place // 16)"
    return ", ".join(up(k) for k in range(1, levels + 1))


def _all_sql(base: str, key: str, levels: int) -> str:
    return " union all ".join(f"select {k} as k, {key}, place, n, node from {base}{k}" for k in range(levels + 1))


def _paths_sql(base: str, key: str) -> str:
    """Of each node of level 0 the list of "left|right" siblings, level by level."""
    return f"""select {key}, place, list(l || '|' || r order by k) as path from (
  select b.{key}, b.place, a.k, coalesce(string_agg(a.node, '' order by a.place) filter (a.place < b.place // (16 ** a.k)::bigint), '') as l,
         coalesce(string_agg(a.node, '' order by a.place) filter (a.place > b.place // (16 ** a.k)::bigint), '') as r
  from {base}0 b join all_{base} a on a.{key} is not distinct from b.{key} and a.place // 16 = b.place // (16 ** (a.k + 1))::bigint where a.n > 1 group by all) group by all"""


_LEAF = lambda text: "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
OP11_SQL = f"""
with d as (select doc_id, source, {_LEAF("text")} as node, case when {_CRC} % 5 = 0 then {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered from documents),
 n0 as (select *, row_number() over (partition by source order by doc_id nulls first, node) - 1 as place, count(*) over (partition by source) as n from d),
 {_tree_sql("n", "source", 7)}, all_n as ({_all_sql("n", "source", 7)}), s as (select source, node from all_n where n = 1),
 t0 as (select 0 as one, source, node, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from s),
 {_tree_sql("t", "one", 7)}, all_t as ({_all_sql("t", "one", 7)}), top as (select node as root from all_t where n = 1),
 pn as ({_paths_sql("n", "source")}), pt as ({_paths_sql("t", "one")}),
 p as (select n0.doc_id, n0.node as leaf, tampered, t0.node as subroot, root, list_concat(coalesce(pn.path, []), coalesce(pt.path, [])) as path
       from n0 join t0 on n0.source is not distinct from t0.source cross join top
       left join pn on pn.source is not distinct from n0.source and pn.place = n0.place left join pt on pt.place = t0.place),
 f as (select *, list_reduce(list_concat([coalesce(tampered, leaf)], path), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) as folded_root from p)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) as proof_sha256, folded_root, folded_root = root as verified from f
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from the archives that it was written to."""
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.page_records(table(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z"), path)
    columns = "record_id string, record_type string, payload_digest string, payload_length long, refers_to string, payload binary"
    found = warc.read(spark, path, columns, [("record_type", "in", ["response", "revisit"])])
    # what a response holds is measured; a revisit says what it refers to
    payload = F.col("payload")
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"), F.coalesce(F.octet_length(payload).cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1(payload), "payload_digest").alias("payload_digest"), "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


OP12_SQL = r"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
 k as (select *, max(page_id) over (partition by payload_digest) as kept from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < kept then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < kept then kept end as refers_to from k
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first 2,000 phrases of each language."""
    return collocations.ranked(collocations.collocations(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents where text is not null),
 spans as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces where len(w) > 0), each as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from spans, range(1, 6) x(m) where i + m - 1 <= len(w)),
 totals as (select lang, count(*) as n from each where m = 1 group by lang), counts as (select lang, m, phrase, count(*) as c from each group by all having count(*) >= 100),
 cand as (select lang, m, phrase, c as a, string_split(phrase, ' ') as w from counts where m > 1),
 cuts as (select lang, phrase, a, m, k, array_to_string(w[:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y from cand, range(1, 5) t(k) where k < m),
 scored as (select cuts.*, l.c as l, r.c as r, n, (1000::hugeint * a * n // (l.c::hugeint * r.c))::bigint as score from cuts join counts l on l.lang = cuts.lang and l.phrase = x join counts r on r.lang = cuts.lang and r.phrase = y join totals on totals.lang = cuts.lang),
 best as (select *, row_number() over (partition by lang, phrase order by score, k) as place from scored),
 kept as (select * from best b where place = 1 and not exists (select 1 from cand o where o.lang = b.lang and o.m > b.m and 100 * o.a >= 100 * b.a and contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))),
 placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from placed where rank <= 2000
"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mixing": op9_mixing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc": op12_warc,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op9_mixing": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_warc": OP12_SQL, "op13_collocations": OP13_SQL}
