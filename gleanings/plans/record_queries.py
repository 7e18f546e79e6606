"""Queries over records: dedup, filters, joins, aggregations, windows, paging and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.functions import text as T
from gleanings.functions import urls as U
from gleanings.operators import aggs, dedup, filters, joins, ranking, sets, windows
from gleanings.plans.registry import query
from gleanings.plans.text_queries import _lines_sql
from gleanings.plans.web_queries import _KEY, _NORM, _P, _SEARCH
from gleanings.session import table
from gleanings.sources import io

_PAGE_TITLE = "'page ' || (page_id % 50)"


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("page "), F.col("page_id") % 50).alias("title"), U.netloc(F.col("url")).alias("source_name"))


# -- dedup ---------------------------------------------------------------------------------------------------------------------------
query("dedup_exact", f"with {_P}, n as (select page_id, {_NORM} as u from parts) select min(page_id) as page_id, sha256(u) as fingerprint from n group by u")(lambda spark, d: dedup.dedup_exact(_pages(spark, d), "page_id").select("page_id", "fingerprint"))


@query("new_only", f"""with {_P}, n as (select page_id, {_NORM} as u, {_PAGE_TITLE} as title, net as source_name from parts),
 old as (select * from n where page_id % 3 = 0)
 select page_id from n where page_id % 3 <> 0 and u not in (select u from old) and (title, source_name) not in (select (title, source_name) from old)""")
def new_only(spark, d):
    p = _pages(spark, d).withColumn("fingerprint", U.fingerprint(F.col("url")))
    return dedup.new_only(p.filter("page_id % 3 <> 0"), p.filter("page_id % 3 = 0")).select("page_id")


@query("merge_hits", f"""with {_P}, n as (select page_id, page_id % 7 as query_ord, {_SEARCH} as norm_url from parts)
 select norm_url, arg_min(page_id, query_ord * 100000000 + page_id) as page_id from n where norm_url <> '' group by norm_url""")
def merge_hits(spark, d):
    hits = _pages(spark, d).select("page_id", "url", (F.col("page_id") % 7).alias("query_ord"), F.col("page_id").alias("rank"))
    return dedup.merge_hits(hits).select("norm_url", "page_id")


@query("exclude_seen", f"""with {_P}, n as (select page_id, page_id % 5 as series_id, {_KEY} as k from parts)
 select page_id, series_id from n where page_id % 2 = 1 and (series_id, k) not in (select (series_id, k) from n where page_id % 2 = 0)""")
def exclude_seen(spark, d):
    p = _pages(spark, d).withColumn("series_id", F.col("page_id") % 5)
    return dedup.exclude_seen(p.filter("page_id % 2 = 1"), p.filter("page_id % 2 = 0")).select("page_id", "series_id")


@query("collapse_sources", """with s as (select doc_id, case when doc_id % 2 = 0 then upper(source) else ' ' || source end as name from documents)
 select lower(trim(name)) as source_key, arg_min(name, doc_id) as name from s group by 1""")
def collapse_sources(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit(" "), "source")).alias("name"))
    return dedup.collapse_sources(s, "doc_id").select("source_key", "name")


@query(
    "dedupe_terms",
    """with w as (select p_partkey % 10 as key, p_partkey % 2 as priority, p_partkey * 10 + i as ord, string_split(p_type, ' ')[i] as term from part, unnest([1, 2, 3]) t(i)),
 f as (select *, row_number() over (partition by key, lower(term) order by priority, ord) as rn from w where term <> ''),
 n as (select *, row_number() over (partition by key order by priority, ord) as place from f where rn = 1)
 select key, term, place from n where place <= 4""",
)
def dedupe_terms(spark, d):
    w = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("key"), (F.col("p_partkey") % 2).alias("priority"), "p_partkey", F.posexplode(F.split("p_type", " ")).alias("i", "term"))
    w = w.withColumn("ord", F.col("p_partkey") * 10 + F.col("i") + 1)
    return dedup.dedupe_terms(w, 4).select("key", "term", F.col("place").cast("bigint").alias("place"))


@query(
    "dedupe_terms_generic",
    """with w as (select p_partkey % 10 as key, p_partkey as ord, p_type as term from part where p_partkey % 10 < 6),
 f as (select *, row_number() over (partition by key, lower(term) order by ord) as rn from w),
 n as (select *, row_number() over (partition by key order by ord) as place from f where rn = 1)
 select key, term, place from n where place <= 3
 union all select k.key, t.term, t.place from (select distinct p_partkey % 10 as key from part where p_partkey % 10 >= 6) k, lateral (values ('k' || k.key, 1), ('k' || k.key || ' news', 2)) t(term, place)""",
)
def dedupe_terms_generic(spark, d):
    """Keys of which some have no terms of their own, and so get the templates."""
    w = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("key"), F.lit(0).alias("priority"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 10 < 6, F.col("p_type")).otherwise(" ").alias("term"))
    keys = w.select("key", F.concat(F.lit("k"), "key").alias("name")).distinct()
    return dedup.dedupe_terms(w, 3, keys, ("{}", "{} news")).select("key", "term", F.col("place").cast("bigint").alias("place"))


@query(
    "resolve_sources",
    f"""with {_P}, c as (select page_id % 20 as topic, page_id as ord, regexp_replace(url, '/+$', '') as u from parts where page_id % 20 < 15 and page_id % 3 = 0
 union all select page_id % 20, page_id, regexp_replace(url, '/+$', '') from parts where page_id % 20 >= 15),
 a as (select *, row_number() over (partition by topic, u order by ord) as r1 from c),
 b as (select *, row_number() over (partition by topic order by ord) as r2 from a where r1 = 1),
 l as (select * from b where r2 <= 6),
 o as (select *, row_number() over (partition by u order by topic, ord) as r3 from l)
 select topic, u as url from o where r3 = 1""",
)
def resolve_sources(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("topic"), (F.col("page_id") % 20).alias("topic_ord"), F.col("page_id").alias("ord"), F.lit("").alias("name"), "url", "page_id")
    return dedup.resolve_sources(p.filter("topic < 15 and page_id % 3 = 0").drop("page_id"), p.filter("topic >= 15").drop("page_id"), limit=6).select("topic", "url")


@query("pick_version", """with v as (select doc_id div 2 as g, max(case when doc_id % 2 = 0 then length(text) end) as feed, max(case when doc_id % 2 = 1 then length(text) end) as page from (select doc_id, text, doc_id // 2 as x from documents) group by 1)
 select g as url, case when page is not null and page > 1.5 * coalesce(feed, 0) then 'page' when feed is not null then 'feed' else 'page' end as kind from v""".replace("doc_id div 2", "doc_id // 2"))
def pick_version(spark, d):
    v = table(spark, d, "documents").select(F.expr("doc_id div 2").alias("url"), F.when(F.col("doc_id") % 2 == 0, "feed").otherwise("page").alias("kind"), F.col("text").alias("body"), F.lit(True).alias("ok"), F.lit(True).alias("dated"))
    return dedup.pick_version(v).select("url", "kind")


@query(
    "pick_version_all",
    """with d as (select doc_id // 3 as g, doc_id % 3 as r, length(coalesce(text, '')) as n, doc_id % 2 = 0 as ok, doc_id % 5 <> 0 as dated from documents),
 v as (select g, max(case when r = 0 then n end) as plain, max(case when r = 1 then n end) as rendered, max(case when r = 0 then ok end) as pok, max(case when r = 0 then dated end) as pdated, max(case when r = 1 then ok end) as rok, max(case when r = 2 then n end) as third from d group by 1),
 f as (select g as url, case when rendered is not null and (plain is null or ((not pok or not pdated) and rok) or (rendered > 0 and coalesce(plain, 0) <= 1.2 * rendered and not pok)) then 'rendered' when plain is not null then 'plain' end as kind from v where plain is not null or rendered is not null),
 x as (select g + 1000000 as url, case when coalesce(a, 0) < 500 and b is not null and b >= 2 * coalesce(a, 0) then 'full' when a is not null then 'primary' else 'full' end as kind from (select g, max(case when r = 0 then n end) as a, max(case when r <> 0 then n end) as b from d group by 1))
 select * from f
 union all select * from x""",
)
def pick_version_all(spark, d):
    """Plain and rendered fetches, and primary and full extractions, made of three documents each."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 3").alias("g"), (F.col("doc_id") % 3).alias("r"), F.coalesce("text", F.lit("")).alias("body"), (F.col("doc_id") % 2 == 0).alias("ok"), (F.col("doc_id") % 5 != 0).alias("dated"))
    fetched = docs.filter("r < 2").select(F.col("g").alias("url"), F.when(F.col("r") == 0, "plain").otherwise("rendered").alias("kind"), "body", "ok", "dated")
    longest = docs.filter("r > 0").groupBy("g").agg(F.max_by(F.struct("body", "ok", "dated"), F.length("body")).alias("x")).select((F.col("g") + 1_000_000).alias("url"), F.lit("full").alias("kind"), "x.*")
    first = docs.filter("r = 0").select((F.col("g") + 1_000_000).alias("url"), F.lit("primary").alias("kind"), "body", "ok", "dated")
    return dedup.pick_version(fetched.unionByName(longest).unionByName(first)).select("url", "kind")


_SHINGLE_ROWS = r"""b as (select doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '\]\([^)]*\)', ']', 'g'), '[^\p{L}\p{N}_]', '', 'g') as b from documents),
 s as (select distinct doc_id, substr(b, i, 5) as s from (select doc_id, b, unnest(range(1, greatest(length(b) - 4, 1) + 1)) as i from b where b <> ''))"""


@query("shingle_overlap", f"""with {_SHINGLE_ROWS}, n as (select doc_id, count(*) as n from s group by 1),
 o as (select x.doc_id, count(*) as k from s x join s y on y.doc_id = x.doc_id + 1 and x.s = y.s group by 1)
 select x.doc_id, coalesce(k, 0) as "both", x.n + y.n - coalesce(k, 0) as either from n x join n y on y.doc_id = x.doc_id + 1 left join o on o.doc_id = x.doc_id""")
def shingle_overlap(spark, d):
    """Each document against the next one."""
    h = table(spark, d, "documents").select("doc_id", dedup.letters(F.coalesce("text", F.lit(""))).alias("t")).filter("t <> ''")
    both, either, _ = dedup.shingle_overlap(F.col("t"), F.col("t2"))
    return h.join(h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("t2")), "doc_id").select("doc_id", both.alias("both"), either.alias("either"))


#: One row for each set of shingles, named by its smallest document.
_CLASSES = f"""{_SHINGLE_ROWS}, g as (select doc_id, count(*) as n, md5(string_agg(s, chr(1) order by s)) as k from s group by 1),
 c as (select doc_id, n, min(doc_id) over (partition by k) as class_id from g)"""


@query("near_duplicate_classes", f"with {_CLASSES} select doc_id, class_id from c")
def near_duplicate_classes(spark, d):
    """The class of every document with shingles: near_duplicate_pairs has pairs of classes."""
    return dedup.shingle_classes(table(spark, d, "documents"), "doc_id", F.coalesce("text", F.lit("")))[0].select(F.col("id").alias("doc_id"), "class_id")


@query(
    "near_duplicate_pairs",
    f"""with {_CLASSES}, r as (select s.doc_id, s.s, n from s join c using (doc_id) where c.class_id = c.doc_id),
 o as (select x.doc_id as a, y.doc_id as b, x.n as least, count(*) as overlap from r x join r y on x.s = y.s and x.doc_id <> y.doc_id and (x.n < y.n or (x.n = y.n and x.doc_id < y.doc_id)) group by all)
 select a, b, overlap, least from o where overlap * 100 >= least * 82""",
)
def near_duplicate_pairs(spark, d):
    return dedup.near_pairs(table(spark, d, "documents"), "doc_id", F.coalesce("text", F.lit("")))


@query("near_duplicates")
def near_duplicates(spark, d):
    return dedup.near_duplicates(table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text")


@query(
    "near_duplicate_pairs_jaccard",
    f"""with {_CLASSES}, r as (select s.doc_id, s.s, n from s join c using (doc_id) where c.class_id = c.doc_id),
 o as (select x.doc_id as a, y.doc_id as b, x.n as least, x.n + y.n - count(*) as either, count(*) as overlap from r x join r y on x.s = y.s and x.doc_id <> y.doc_id and (x.n < y.n or (x.n = y.n and x.doc_id < y.doc_id)) group by x.doc_id, y.doc_id, x.n, y.n)
 select a, b, overlap, least from o where overlap * 100 >= either * 82""",
)
def near_duplicate_pairs_jaccard(spark, d):
    return dedup.near_pairs(table(spark, d, "documents"), "doc_id", F.coalesce("text", F.lit("")), metric="jaccard")


@query("near_duplicates_minhash")
def near_duplicates_minhash(spark, d):
    """What stays by the lossy search; the tests hold its pairs against those of near_duplicate_pairs_jaccard."""
    return dedup.near_duplicates(table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text", approximate=True)


# -- filters -------------------------------------------------------------------------------------------------------------------------
_NOW = "timestamp '1998-01-01 00:00:00'"
_ORDERS = "o as (select o_orderkey, o_custkey, case when o_orderkey % 11 = 0 then null else cast(o_orderdate as timestamp) end as seen_at from orders)"


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("at", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp")))


def _now():
    return F.lit("1998-01-01 00:00:00").cast("timestamp")


query("filter_by_age", f"with {_ORDERS} select o_orderkey from o where seen_at >= {_NOW} - interval 180 days")(lambda spark, d: filters.filter_by_age(_orders(spark, d), "at", _now(), 180).select("o_orderkey"))
query("age_funnel", f"with {_ORDERS} select case when seen_at is null then 'no_date' when seen_at >= {_NOW} - interval 180 days then 'kept' else 'too_old' end as verdict, count(*) as n from o group by all")(
    lambda spark, d: _orders(spark, d).groupBy(filters.age_verdict(F.col("at"), _now(), 180).alias("verdict")).agg(F.count("*").alias("n"))
)
query("filter_by_age_relaxed", f"""with {_ORDERS}, f as (select *, coalesce(seen_at >= {_NOW} - interval 180 days, false) as fresh from o),
 n as (select *, sum(fresh::int) over (partition by o_custkey) < 2 as relaxed from f)
 select o_orderkey, relaxed as time_range_relaxed from n where fresh or relaxed""")(
    lambda spark, d: filters.filter_by_age_relaxed(_orders(spark, d), "o_custkey", "at", _now(), 180).select("o_orderkey", "time_range_relaxed")
)
query("cap_per_source", "select doc_id from (select doc_id, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 5")(lambda spark, d: filters.cap_per_source(table(spark, d, "documents"), "source", "doc_id", 5).select("doc_id"))
query("cap_run", "select doc_id, source from documents order by doc_id limit 10")(lambda spark, d: filters.cap_run(table(spark, d, "documents"), "doc_id").select("doc_id", "source"))


def _hits_sql(strict: bool) -> str:
    return f"""with q as (select item_id as query_id, lower(case when item_id % 3 = 0 then '水印识别 去除' when item_id % 3 = 1 then '!' else text end) as q from benchmark),
 t as (select query_id, list_distinct(regexp_extract_all(q, '[a-z0-9]{{2,}}')) as latin, case when contains(q, '水印') then ['水印', '印识', '识别', '去除'] else [] end as pairs from q),
 n as (select count(*) as n from benchmark),
 h as (select doc_id as hit_id, doc_id % n as query_id, lower(split_part(text, chr(10), 1) || ' ' || text || case when doc_id % 2 = 0 then ' 识别 水印' else '' end) as hay from documents, n),
 j as (select *, len(list_filter(pairs, lambda p: contains(hay, p))) as found from h join t using (query_id))
 select query_id, hit_id from j where len(list_filter(latin, lambda x: contains(hay, x))) >= 1 or (found >= least(2, len(pairs)) and {"len(pairs) > 0" if strict else "true"}) or (len(latin) = 0 and len(pairs) = 0)"""


def _hits(spark, d, strict: bool):
    """Documents dealt to all benchmark items: queries as they are, in Chinese, and without any term; half of the hits have the Chinese words."""
    b = table(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.expr("case when item_id % 3 = 0 then '水印识别 去除' when item_id % 3 = 1 then '!' else text end").alias("query"))
    n = b.agg(F.count("*").alias("n"))  # one row
    docs = table(spark, d, "documents").join(F.broadcast(n), F.col("n") >= 0)
    h = docs.select(F.col("doc_id").alias("hit_id"), (F.col("doc_id") % F.col("n")).alias("query_id"), F.substring_index("text", "\n", 1).alias("title"), F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" 识别 水印")).otherwise("")).alias("snippet"))
    return filters.hits_for_query(h, q, strict=strict).select("query_id", "hit_id")


query("filter_hits_for_query", _hits_sql(True))(lambda spark, d: _hits(spark, d, True))
query("filter_hits_loose", _hits_sql(False))(lambda spark, d: _hits(spark, d, False))


_GATE = """with r as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents),
 c as (select doc_id, i // 8 as chunk, i % 8 as slot from r)
 select doc_id from c where case chunk % 5 when 0 then slot in (0, 3) when 1 then false when 2 then slot in (1, 2) else true end"""


@query("relevance_gate", _GATE)
def relevance_gate(spark, d):
    """Every document through the gate; the replies of a chunk are lists, an empty list, objects, rubbish or none."""
    docs = table(spark, d, "documents")
    chunks = filters.chunked(docs.select("doc_id"), "doc_id", 8).select("chunk").distinct()
    reply = F.expr("case chunk % 5 when 0 then 'Keep: [0, \"3\", 99] ok' when 1 then '[]' when 2 then '[{\"index\": 1}, {\"id\": 2}]' when 3 then 'none of them' end")
    return filters.relevance_gate(docs, chunks.withColumn("reply", reply), "doc_id").select("doc_id")


query("batch_rows", "select doc_id, (row_number() over (order by doc_id) - 1) // 7 as chunk from documents")(lambda spark, d: filters.chunked(table(spark, d, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "chunk"))


@query("stub_guard", """with c as (select conv_id, sum(length(text)) filter (where role = 'user') as src, sum(length(text)) filter (where role <> 'user') as body from conversations group by 1)
 select conv_id, cast(case when coalesce(src, 0) < 300 then 0 when src < 1500 then src else least(greatest(floor(src * 0.2), 1500), 3000) end as bigint) as required, coalesce(body, 0) >= case when coalesce(src, 0) < 300 then 0 when src < 1500 then src else least(greatest(floor(src * 0.2), 1500), 3000) end as kept from c""")
def stub_guard(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("role") == "user", F.length("text"))), F.lit(0)).alias("src"), F.coalesce(F.sum(F.when(F.col("role") != "user", F.length("text"))), F.lit(0)).alias("body"))
    need = filters.required_length(F.col("src"))
    return c.select("conv_id", need.alias("required"), (F.col("body") >= need).alias("kept"))


query("synthesis_floor", "select conv_id, turn, case turn % 4 when 0 then 500 when 1 then 600 when 2 then 800 else 0 end as floor from conversations")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", filters.synthesis_floor(F.expr("case turn % 4 when 0 then 'beginner' when 1 then 'intermediate' when 2 then 'advanced' end")).alias("floor"))
)
query("source_search", "select s_suppkey from supplier where s_suppkey % 2 = 0 and (s_suppkey % 3 <> 0 or s_suppkey % 5 = 0)")(
    lambda spark, d: filters.source_search(_named_sources(spark, d), "SUPPLIER", topic="even", mode="list").select("s_suppkey")
)
query("list_filter", "select doc_id from documents where source = 'src3' and lang = 'en'")(lambda spark, d: filters.list_filter(table(spark, d, "documents"), source="src3", lang="en").select("doc_id"))


@query("preflight", """with c as (select conv_id as chapter_id, count(*) as n1, count(*) filter (where role = 'user') * 3 as n2 from conversations group by 1)
 select chapter_id, case when n1 < 4 and n2 > n1 then n2 else n1 end as n_hits, case when n1 < 4 and n2 > n1 then n2 else n1 end < 4 as thin from c""")
def preflight(spark, d):
    c = table(spark, d, "conversations")
    again = c.filter("role = 'user'").select(F.col("conv_id").alias("chapter_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return filters.preflight(c.select(F.col("conv_id").alias("chapter_id"), F.lit("").alias("title")).distinct(), c.select(F.col("conv_id").alias("chapter_id")), again).select("chapter_id", "n_hits", "thin")


@query("first_nonempty_wave", """with h as (select doc_id, doc_id % 30 as query_id, (doc_id // 30) % 3 as wave, lang = 'en' as relevant from documents),
 m as (select *, min(case when relevant then wave end) over (partition by query_id) as w from h)
 select doc_id from m where relevant and wave = w""")
def first_nonempty_wave(spark, d):
    h = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 30).alias("query_id"), F.expr("(doc_id div 30) % 3").alias("wave"), (F.col("lang") == "en").alias("relevant"))
    return filters.first_nonempty_wave(h).select("doc_id")


query("keyword_search", "select p_partkey, p_name from part where contains(lower(p_name), 'blue') or contains(lower(p_type), 'blue') or contains(lower(p_name), 'green')")(
    lambda spark, d: filters.keyword_search(table(spark, d, "part"), " BLUE ", ["p_name", "p_type"]).unionByName(filters.keyword_search(table(spark, d, "part"), "green", ["p_name"])).select("p_partkey", "p_name").distinct()
)

# -- joins ---------------------------------------------------------------------------------------------------------------------------
@query("drafts_with_articles", "select o_orderkey as draft_id, c_custkey as article_id, c_name as article_title from orders left join customer on c_custkey = o_custkey and c_custkey % 7 <> 0 where o_orderstatus = 'O'".replace("c_custkey as article_id", "o_custkey as article_id"))
def drafts_with_articles(spark, d):
    drafts = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft_id"), F.col("o_custkey").alias("article_id"), F.col("o_orderstatus").alias("status"))
    articles = table(spark, d, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("article_id"), F.col("c_name").alias("article_title"))
    return joins.drafts_with_articles(drafts, articles, "O").select("draft_id", "article_id", "article_title")


@query("series_source_urls", "select distinct o_custkey as series_id, p_name as url from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey where o_orderkey <> 1")
def series_source_urls(spark, d):
    bridge = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_partkey").alias("article_id"))
    drafts = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft_id"), F.col("o_custkey").alias("series_id"))
    articles = table(spark, d, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("url"))
    return joins.series_source_urls(bridge, drafts, articles, exclude_draft=1)


@query("series_drafts", "select conv_id as series_id, turn as series_order, doc_id, source from conversations left join documents on doc_id = conv_id * 3 + turn")
def series_drafts(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("series_id"), F.col("turn").alias("series_order"), (F.col("conv_id") * 3 + F.col("turn")).alias("article_id"))
    return joins.drafts_with_articles(c, table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "doc_id", "source")).select("series_id", "series_order", "doc_id", "source")


_BRIDGE = """with s as (select conv_id as draft_id, (conv_id + turn // 2) % 50 as article_id, turn, row_number() over (partition by conv_id order by turn) as pos from conversations),
 f as (select *, row_number() over (partition by draft_id, article_id order by pos) as rn from s where article_id <> 13)
 select draft_id, article_id, pos as rank, case when pos = 1 then 'primary' else 'source' end as role from f where rn = 1"""


@query("build_bridge", _BRIDGE)
def build_bridge(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.expr("(conv_id + turn div 2) % 50 <> 13"), F.expr("(conv_id + turn div 2) % 50")).alias("article_id"))
    s = F.transform(F.array_sort(F.collect_list(F.struct("turn", "article_id"))), lambda x: F.struct(x["article_id"].alias("article_id"), F.lit(None).cast("bigint").alias("rank"), F.lit("").alias("role")))
    return joins.build_bridge(c.groupBy(F.col("conv_id").alias("draft_id")).agg(s.alias("sources"))).select("draft_id", "article_id", F.col("rank").cast("bigint").alias("rank"), "role")


query("draft_of_article", "select o_custkey as article_id, min(o_orderkey) as first_draft, max(o_orderkey) as current_draft from orders group by 1")(
    lambda spark, d: joins.draft_of_article(table(spark, d, "orders").select(F.col("o_custkey").alias("article_id"), F.col("o_orderkey").alias("draft_id")))
)

#: Small topics of our own for the Latin test tables.
TOPICS = [("legal", ["licensed under", "copyright"]), ("short", ["the", "una"]), ("german", ["der", "keit"])]


@query("classify_topics", """with t as (select doc_id, lower(text) as x from documents)
 select doc_id, case when contains(x, 'licensed under') or contains(x, 'copyright') then 'legal' when regexp_matches(x, '(^|[^\\p{L}\\p{N}_])(the|una)([^\\p{L}\\p{N}_]|$)') then 'short'
 when regexp_matches(x, '(^|[^\\p{L}\\p{N}_])(der|keit)([^\\p{L}\\p{N}_]|$)') then 'german' when doc_id % 4 = 0 then 'german' else 'uncategorized' end as topic from t""")
def classify_topics(spark, d):
    docs = table(spark, d, "documents")
    replies = docs.filter("doc_id % 4 = 0").select("doc_id", F.lit('The topic is "german".').alias("reply"))
    return joins.classify_topics(docs, TOPICS, F.col("text"), replies)


@query("citation_links", """with s as (select conv_id, count(*) as n from conversations group by 1)
 select c.conv_id as draft_id, c.turn as claim_no, i as source_no, 'u' || (c.conv_id * 100 + i) as url from conversations c join s using (conv_id), unnest([0, 1, 2, 3]) t(i) where i between 1 and n and trim(c.text) <> ''""")
def citation_links(spark, d):
    c = table(spark, d, "conversations")
    per = c.groupBy(F.col("conv_id").alias("draft_id")).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("claim")))).alias("t"))
    drafts = per.select("draft_id", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.concat(F.lit("u"), (F.col("draft_id") * 100 + i).cast("string")).alias("url"))).alias("sources"), F.transform("t", lambda x: F.struct(x["claim"].alias("claim"), F.array(*[F.lit(i) for i in (0, 1, 2, 2, 3)]).alias("source_indexes"))).alias("citations"))
    found = joins.citation_links(drafts)
    turns = c.select(F.col("conv_id").alias("draft_id"), "turn", (F.row_number().over(windows.W.partitionBy("conv_id").orderBy("turn")) - 1).alias("claim_no"))
    return found.join(turns, ["draft_id", "claim_no"]).select("draft_id", F.col("turn").alias("claim_no"), "source_no", "url")


@query("prerequisite_links", """with c as (select conv_id as series_id, turn as chapter_order, role as title from conversations)
 select a.series_id, a.chapter_order, w as wanted, min(b.chapter_order) as linked_order from c a cross join unnest(['user', 'nobody']) t(w) left join c b on b.series_id = a.series_id and b.title = w and b.chapter_order < a.chapter_order group by all""")
def prerequisite_links(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("series_id"), F.col("turn").alias("chapter_order"), F.col("role").alias("title"), F.array(F.lit("user"), F.lit("nobody")).alias("prerequisites"))
    return joins.prerequisite_links(c)


@query("delete_cascade", "select 'orders' as kept_of, count(*) as n from orders where o_orderkey % 9 <> 0 union all select 'lineitem', count(*) from lineitem where l_orderkey % 9 <> 0")
def delete_cascade(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    parents, children = joins.delete_cascade(o, li, o.filter("o_orderkey % 9 = 0").select("o_orderkey"), "o_orderkey", "l_orderkey")
    return parents.agg(F.count("*").alias("n")).select(F.lit("orders").alias("kept_of"), "n").unionByName(children.agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("kept_of"), "n"))


@query("widen_references", f"""with {_P}, k as (select page_id, page_id % 60 as g, {_KEY} as k from parts),
 p as (select * from k where page_id % 120 < 60 or page_id < 60),
 n as (select g, count(*) as n from p group by 1),
 w as (select k.*, row_number() over (partition by k.g, k order by page_id) as rn from k where not (page_id % 120 < 60 or page_id < 60)),
 x as (select w.page_id, w.g, true as widened from w left join n using (g) where rn = 1 and coalesce(n, 0) < 2 and (w.g, w.k) not in (select (g, k) from p)),
 u as (select page_id, g, false as widened from p
 union all select * from x),
 r as (select *, row_number() over (partition by g order by widened, page_id) as place from u)
 select g as "group", page_id, widened from r where place <= 3""")
def widen_references(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", (F.col("page_id") % 60).alias("group"), F.col("page_id").alias("ord"))
    own = (F.col("page_id") % 120 < 60) | (F.col("page_id") < 60)
    return joins.widen_references(p.filter(own), p.filter(~own), 3).select("group", "page_id", "widened")


_HAS_COPY = "select url, min(page_id) as n from pages where page_id % 2 = 0 group by url"


@query(
    "localize_urls",
    rf"""with m as (select url, 'media/' || n || '.html' as local from ({_HAS_COPY})),
 a as (select page_id, url, coalesce(local, url) as new, local from pages left join m using (url))
 select page_id as id, 'see ![](' || case when local is not null then '../' || local else url end || ') of page ' || page_id || ' and <video src="' || case when local is not null then '../' || local else url end || '">' as body, 'http://other.example/x.png' as images, new || chr(10) || 'media/film.mp4' as videos from a""",
)
def localize_urls(spark, d):
    """Addresses that stand in the body alone, or as a video, of which every second one has a local copy; in the body with a relative path."""
    p = table(spark, d, "pages")
    body = F.concat(F.lit("see ![]("), "url", F.lit(") of page "), "page_id", F.lit(' and <video src="'), "url", F.lit('">'))
    a = p.select(F.col("page_id").alias("id"), body.alias("body"), F.array(F.lit("http://other.example/x.png")).alias("images"), F.array(F.col("url"), F.lit("http://films.example/f.mp4")).alias("videos"))
    copies = p.filter("page_id % 2 = 0").groupBy(F.col("url").alias("remote")).agg(F.concat(F.lit("media/"), F.min("page_id"), F.lit(".html")).alias("local"))
    film = p.limit(1).select(F.lit("http://films.example/f.mp4").alias("remote"), F.lit("media/film.mp4").alias("local"))
    found = joins.localize_urls(a, copies.unionByName(film), body_prefix="../")
    return found.select("id", "body", F.array_join("images", "\n").alias("images"), F.array_join("videos", "\n").alias("videos"))


def _pictures(spark, d):
    p = table(spark, d, "pages").select(F.expr("page_id div 5").alias("draft_id"), (F.col("page_id") % 5).alias("source_no"), F.array(*[F.concat(F.lit("https://"), U.netloc(F.col("url")), F.lit("/"), F.col("page_id").cast("string"), F.lit(x)) for x in ("/a.jpg", "/logo.svg", "/b.png")], F.lit("data:image/png;base64,x")).alias("images"))
    return p


@query("image_manifest", f"""with {_P}, e as (select page_id // 5 as draft_id, page_id % 5 as source_no, 'https://' || net || '/' || page_id || s.x as url, s.i as i from parts, unnest([{{'x': '/a.jpg', 'i': 0}}, {{'x': '/b.png', 'i': 2}}]) t(s))
 select draft_id, row_number() over (partition by draft_id order by source_no, i) - 1 as n, source_no, url from e""")
def image_manifest(spark, d):
    return windows.image_manifest(_pictures(spark, d)).select("draft_id", F.col("n").cast("bigint").alias("n"), "source_no", "url")


@query(
    "resolve_image_refs",
    f"""with {_P}, e as (select page_id // 5 as draft_id, page_id % 5 as source_no, 'https://' || net || '/' || page_id || s.x as url, s.i as i from parts, unnest([{{{{'x': '/a.jpg', 'i': 0}}}}, {{{{'x': '/b.png', 'i': 2}}}}]) t(s)),
 m as (select draft_id, row_number() over (partition by draft_id order by source_no, i) - 1 as n, url from e),
 d as (select page_id // 5 as draft_id, min(url) as u from pages group by 1),
 r as (select d.draft_id, u, max(case when n = 0 then url end) as a, max(case when n = 3 then url end) as b, count(*) as pictures from d join m using (draft_id) group by all)
 select draft_id, u || chr(10) || 'one ![](' || a || ')' || chr(10) || chr(10) || case when b is null then '' else '![](' || b || ')' end || ' and ' as body, case when b is null then '0' else '0,3' end as resolved, case when b is null then '3,99' else '99' end as dropped from r""".replace("{{", "{").replace("}}", "}"),
)
def resolve_image_refs(spark, d):
    """A body for every five pages, with their first address, whose pictures are numbered through."""
    p = _pictures(spark, d)
    first = table(spark, d, "pages").groupBy(F.expr("page_id div 5").alias("draft_id")).agg(F.min("url").alias("u"))
    drafts = first.select("draft_id", F.concat("u", F.lit("\none [[IMG:0]]\n\n\n\n[[IMG:3]] and [[IMG:99]]")).alias("body"))
    found = joins.resolve_image_refs(drafts, windows.image_manifest(p))
    return found.select("draft_id", "body", F.array_join("resolved", ",").alias("resolved"), F.array_join("dropped", ",").alias("dropped"))


@query("sync_title_scores", "select doc_id as draft_id, split_part(text, chr(10), 1) as title, cast(length(text) as double) as score from documents where doc_id % 2 = 0")
def sync_title_scores(spark, d):
    t = F.substring_index("text", "\n", 1)
    score = F.length("text").cast("double")
    drafts = table(spark, d, "documents").select(F.col("doc_id").alias("draft_id"), F.when(F.col("doc_id") % 2 == 0, F.array(t)).otherwise(F.array(F.lit("no such title \u0001"))).alias("title_candidates"), F.array(F.struct(t.alias("title"), score.alias("score")), F.struct(F.lit("gone \u0002").alias("title"), F.lit(1.0).alias("score"))).alias("title_scores"))
    return joins.sync_title_scores(drafts).select("draft_id", F.explode("title_scores").alias("s")).select("draft_id", "s.title", "s.score")


# -- aggregations --------------------------------------------------------------------------------------------------------------------
query("dashboard_stats", "select (select count(*) from documents) as articles, (select count(*) from orders) as drafts, (select count(*) from events) as runs")(
    lambda spark, d: aggs.dashboard_stats(articles=table(spark, d, "documents"), drafts=table(spark, d, "orders"), runs=table(spark, d, "events"))
)
query("count_filtered", "select count(*) as n from documents where lang = 'de'")(lambda spark, d: aggs.count_filtered(table(spark, d, "documents"), lang="de"))
query("distinct_topics", "select distinct lang from documents where lang is not null")(lambda spark, d: aggs.distinct_values(table(spark, d, "documents"), "lang"))
query("distinct_sources", "select distinct source from documents where source is not null")(lambda spark, d: aggs.distinct_values(table(spark, d, "documents"), "source"))


@query("topic_source_stats", """with a as (select event_id, case when event_id % 13 = 0 then ' ' else event_type end as topic, ts from events),
 n as (select l_orderkey as event_id, count(*) as n from lineitem group by 1),
 mid as (select cast(min(ts) as date) + 3 as day from events)
 select case when trim(topic) = '' then 'unclassified' else trim(topic) end as topic, count(*) as total, count(*) filter (where cast(ts as date) >= day) as recent, cast(coalesce(sum(n), 0) as bigint) as drafts from a left join n using (event_id), mid group by 1""")
def topic_source_stats(spark, d):
    e = table(spark, d, "events")
    a = e.select(F.col("event_id").alias("article_id"), F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.col("event_type")).alias("topic"), F.col("ts").alias("at"))
    day = e.agg(F.date_add(F.min("ts").cast("date"), 3).alias("day"))  # one row
    dated = a.join(F.broadcast(day), F.col("day").isNotNull())
    return aggs.topic_stats(dated, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id")), F.col("day"))


@query("source_stats", """with mid as (select cast(min(ts) as date) + 3 as day from events)
 select event_type as source, count(*) as total, count(*) filter (where cast(ts as date) >= day) as recent from events, mid group by 1""")
def source_stats(spark, d):
    e = table(spark, d, "events")
    day = e.agg(F.date_add(F.min("ts").cast("date"), 3).alias("day"))  # one row
    return aggs.source_stats(e.select(F.col("event_type").alias("source"), F.col("ts").alias("at")).join(F.broadcast(day), F.col("day").isNotNull()), F.col("day"))


@query("hotness", """with t as (select source as name, count(*) as total, avg(length(text)) as l from documents group by 1)
 select name, total, least(100, case when name <> 'src3' then least(greatest(cast(length(name) * 20 as double), 0), 100) else 30 end + 3 * least(total % 20, 15)) as score from t""")
def hotness(spark, d):
    t = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("total"))
    scores = t.filter("name <> 'src3'").select("name", (F.length("name") * 20.0).alias("score"))
    return aggs.hotness(t, scores, t.select("name", (F.col("total") % 20).alias("hits")))


@query("hotness_unscored", """with t as (select source as name, count(*) as total from documents group by 1),
 n as (select distinct source as name from documents where source <> 'src1' union select 'no such source'),
 j as (select name, coalesce(total, 0) as total from n left join t using (name))
 select name, total, cast(least(total * 2.0, 50.0) as double) as score, row_number() over (order by least(total * 2.0, 50.0) desc, total desc, name) as place from j""")
def hotness_unscored(spark, d):
    """Names of a configuration, one of them without any document, without outside scores, in order."""
    docs = table(spark, d, "documents")
    names = docs.filter("source <> 'src1'").select(F.col("source").alias("name")).unionByName(docs.limit(1).select(F.lit("no such source").alias("name")))
    found = aggs.by_hotness(aggs.hotness(docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("total")), names=names))
    # a handful of sources
    return found.withColumn("place", F.row_number().over(W.orderBy(F.col("score").desc(), F.col("total").desc(), "name")).cast("bigint"))


@query(
    "archive_by_day",
    """with r as (select *, (row_number() over (partition by o_orderdate order by o_orderpriority, o_orderkey) - 1) // 3 as page, count(*) over (partition by o_orderdate) as n from orders)
 select strftime(o_orderdate, '%Y-%m-%d') as day, n, page, string_agg(o_orderpriority || ':' || o_orderkey, ',' order by o_orderpriority, o_orderkey) as items from r group by all""",
)
def archive_by_day(spark, d):
    """Three orders a row, so that most days have several."""
    found = aggs.archive_by_day(table(spark, d, "orders"), "o_orderdate", "o_orderpriority", "o_orderkey", 3)
    items = F.array_join(F.transform("items", lambda x: F.concat(x["source"], F.lit(":"), x["id"].cast("string"))), ",")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "page", items.alias("items"))


@query("sensitive_counts", """with h as (select doc_id, w as word, len(regexp_extract_all(lower(text), w)) + len(regexp_extract_all(lower(split_part(text, chr(10), 1)), w)) as n from documents, unnest(['licensed', 'idiot', 'pathetic']) t(w))
 select doc_id as draft_id, string_agg(word || '×' || n, ', ' order by word || '×' || n) as hits from h where n > 0 group by 1""")
def sensitive_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("body"), F.lower(F.substring_index("text", "\n", 1)).alias("title"))
    words = F.array(*map(F.lit, ("licensed", "idiot", "pathetic")))
    fields = docs.select("doc_id", F.explode(F.array("body", "title")).alias("field"))
    hits = fields.select(F.col("doc_id").alias("draft_id"), "field", F.explode(words).alias("word")).withColumn("n", ranking.occurrences(F.col("field"), F.col("word")))
    return aggs.sensitive_counts(hits)


_CHAPTER = "case o_orderstatus when 'F' then 'done' when 'O' then 'failed' else 'writing' end"


@query("series_status", f"""with c as (select o_custkey as series_id, {_CHAPTER} as status from orders),
 a as (select series_id, count(*) as n, count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed, bool_or(status = 'writing') as busy from c group by 1)
 select c_custkey as series_id, case when n is null then 'failed' when busy then 'running' when done = 0 then 'failed' when done = n then 'done' else 'partial' end as status, coalesce(done, 0) as done, coalesce(failed, 0) as failed from customer left join a on series_id = c_custkey""")
def series_status(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("series_id"), F.expr(_CHAPTER).alias("status"))
    return aggs.series_status(table(spark, d, "customer").select(F.col("c_custkey").alias("series_id")), c)


@query("run_funnel", f"""with {_P}, n as (select page_id % 6 as run, page_id, {_NORM} as u from parts),
 f as (select *, row_number() over (partition by u order by page_id) = 1 as fresh from n)
 select run, count(*) as fetched, count(*) filter (where fresh) as archived, count(*) filter (where fresh and page_id % 2 = 0) as classified from f group by 1""")
def run_funnel(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 6).alias("run"), "page_id", U.normalize_url(F.col("url")).alias("u"))
    p = p.withColumn("fresh", F.row_number().over(windows.W.partitionBy("u").orderBy("page_id")) == 1)
    return aggs.run_funnel(p, "run", {"fetched": F.lit(True), "archived": F.col("fresh"), "classified": F.col("fresh") & (F.col("page_id") % 2 == 0)})


@query("reachability_summary", """with c as (select user_id as source, event_type as candidate, event_id % 10 as candidate_ord, event_id, event_id % 5 as attempt, value > 100 as ok from events)
 select source, bool_or(ok) as reachable, case when bool_or(ok) then min(candidate_ord) filter (where ok) end as first_ord from c where attempt <= 3 group by 1""")
def reachability_summary(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("candidate"), (F.col("event_id") % 10).alias("candidate_ord"), (F.col("event_id") % 5).alias("attempt"), (F.col("value") > 100).alias("ok"))
    return aggs.reachability(c.withColumn("candidate", F.col("candidate_ord"))).select("source", "reachable", F.col("repaired_to").alias("first_ord"))


@query("reachability_totals", """with c as (select user_id as source, bool_or(value > 100) as ok from events where event_id % 5 <= 3 group by 1)
 select count(*) as sources, count(*) filter (where ok) as reachable, count(*) filter (where not ok) as unreachable, count(*) filter (where ok) as repaired from c""")
def reachability_totals(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("candidate"), (F.col("event_id") % 10).alias("candidate_ord"), (F.col("event_id") % 5).alias("attempt"), (F.col("value") > 100).alias("ok"))
    return aggs.reachability_totals(aggs.reachability(c))


# -- windows -------------------------------------------------------------------------------------------------------------------------
query("source_diverse_topk", """with r as (select doc_id, source, n_chars, row_number() over (partition by lower(source) order by n_chars desc, doc_id) > 2 as late from documents)
 select doc_id, source from r order by late, n_chars desc, doc_id limit 50""")(
    lambda spark, d: windows.source_diverse_topk(table(spark, d, "documents").withColumn("rank", F.struct((-F.col("n_chars")).alias("a"), "doc_id")), 50).select("doc_id", "source")
)


@query("rank_titles", """with t as (select p_partkey % 200 as draft_id, p_partkey as ord, trim(p_name) as title, p_retailprice / 7 as score from part),
 u as (select *, row_number() over (partition by draft_id, title order by ord) as d from t where title <> ''),
 r as (select draft_id, title, round_even(coalesce(score, 0), 2) as score, ord from u where d = 1),
 p as (select *, row_number() over (partition by draft_id order by length(title) > 30, score desc, ord) as place from r)
 select draft_id, title, place from p where place <= 5""")
def rank_titles(spark, d):
    t = table(spark, d, "part").select((F.col("p_partkey") % 200).alias("draft_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), (F.col("p_retailprice") / 7).alias("score"), F.lit("").alias("reason"))
    return windows.rank_titles(t).select("draft_id", "title", F.col("place").cast("bigint").alias("place"))


@query("grounding_sample", f"""with {_P}, h as (select page_id % 12 as query_id, page_id as rank, regexp_replace(lower(net), '^www\\.', '') as dom, '- ' || url || '：' || substr(url || ' about ' || url, 1, 180) as line from parts),
 s as (select *, row_number() over (partition by query_id, dom order by rank) as rn from h),
 u as (select query_id, rank, line, sum(length(line)) over (partition by query_id order by rank) as used from s where rn <= 2)
 select query_id, rank, cast(used as bigint) as used from u where used <= 900""")
def grounding_sample(spark, d):
    h = table(spark, d, "pages").select((F.col("page_id") % 12).alias("query_id"), F.col("page_id").alias("rank"), F.col("url").alias("title"), F.concat("url", F.lit(" about "), "url").alias("snippet"), "url")
    return windows.grounding_sample(h, budget=900).select("query_id", "rank", "used")


query("source_budget", """with d as (select doc_id, doc_id % 50 as draft_id, least(length(text), 2500) as want from documents),
 b as (select *, coalesce(sum(want) over (partition by draft_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from d)
 select doc_id, cast(greatest(0, least(want, 18000 - before)) as bigint) as given from b""")(
    lambda spark, d: windows.source_budget(table(spark, d, "documents").withColumn("draft_id", F.col("doc_id") % 50), "draft_id", "doc_id", F.length("text")).select("doc_id", "given")
)
_CH = "c as (select conv_id as series_id, turn as chapter_order, role || ' ' || turn as title, substr(text, 1, 20) as summary, case when turn % 3 = 2 then 'failed' else 'done' end as status from conversations)"


def _named_sources(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k, F.col("s_name").alias("name"), F.concat(F.lit("https://s.example/"), k).alias("url"), F.when(k % 3 == 0, "scrape").otherwise("rss").alias("type"), F.array(F.when(k % 2 == 0, "even").otherwise("odd")).alias("topics"), F.when(k % 5 == 0, "list").otherwise("single").alias("mode"))


def _last_page(spark, d):
    """The page that ends the list; its keys are moved so that they are told from those of another page."""
    orders = table(spark, d, "orders").select((-F.datediff("o_orderdate", F.lit("1970-01-01"))).alias("at"), "o_orderkey")
    return ranking.page_with_more(orders.withColumn("tie", -F.col("o_orderkey")), F.col("at"), "tie", 30, 0).select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), F.lit(False).alias("has_more"))


def _chapters(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("series_id"), F.col("turn").alias("chapter_order"), F.concat_ws(" ", "role", "turn").alias("title"), F.substring("text", 1, 20).alias("summary"), F.when(F.col("turn") % 3 == 2, "failed").otherwise("done").alias("status"), F.col("text").alias("body"))


query("series_nav", f"""with {_CH}, n as (select series_id, chapter_order, title, row_number() over o as part, count(*) over (partition by series_id) as parts, lag(title) over o as previous_title, lead(title) over o as next_title from c window o as (partition by series_id order by chapter_order))
 select * from n where parts >= 2""")(lambda spark, d: windows.series_nav(_chapters(spark, d)))
query("series_context", f"with {_CH} select series_id, chapter_order, coalesce(string_agg(case when status = 'done' then title || ': ' || summary end, chr(10)) over (partition by series_id order by chapter_order rows between unbounded preceding and 1 preceding), '') as context, lead(title) over o as next_title, lag(title) over o is null as opener, lead(title) over o is null as closer from c window o as (partition by series_id order by chapter_order)")(
    lambda spark, d: windows.series_context(_chapters(spark, d))
)
query("latest_op", "select event_type as op_type, arg_max(event_id, (ts, event_id)) as op_id from events group by 1")(lambda spark, d: windows.latest_op(table(spark, d, "events").select(F.col("event_id").alias("op_id"), F.col("event_type").alias("op_type"), "ts")).select("op_type", "op_id"))
query("running_ops", "select event_id as op_id from events where event_type = 'click'")(lambda spark, d: windows.running_ops(table(spark, d, "events").select(F.col("event_id").alias("op_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"))).select("op_id"))
query("log_tail", "select event_id from (select event_id, row_number() over (partition by event_type order by event_id desc) as rn from events) where rn <= 500")(lambda spark, d: windows.log_tail(table(spark, d, "events"), "event_type", "event_id").select("event_id"))


@query("unique_ids", r"""with s as (select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s\-]', '', 'g'), '[\s_\-]+', '-', 'g'), '-') as slug from part),
 e as (select distinct slug from s where p_partkey % 10 = 0),
 n as (select p_partkey, slug, row_number() over (partition by slug order by p_partkey) + case when slug in (select slug from e) then 1 else 0 end as k from s where p_partkey % 10 <> 0)
 select p_partkey, case when k > 1 then slug || '-' || k else slug end as new_id from n""")
def unique_ids(spark, d):
    p = table(spark, d, "part")
    have = p.filter("p_partkey % 10 = 0").select(U.slugify(F.col("p_name")).alias("slug")).distinct()
    return windows.unique_ids(p.filter("p_partkey % 10 <> 0").select("p_partkey", "p_name"), "p_name", "p_partkey", have).select("p_partkey", "new_id")


# -- paging and ranking --------------------------------------------------------------------------------------------------------------
query("recent_page", "select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 60 offset 120")(lambda spark, d: ranking.recent_page(table(spark, d, "orders"), F.col("o_orderdate"), "o_orderkey", 60, 120).select("o_orderkey"))
query("page_with_more", """select o_orderkey, true as has_more from (select * from orders order by o_orderdate desc, o_orderkey desc limit 60 offset 120)
 union all select o_orderkey + 100000000, false from (select * from orders order by o_orderdate, o_orderkey limit 30)""")(
    lambda spark, d: ranking.page_with_more(table(spark, d, "orders"), F.col("o_orderdate"), "o_orderkey", 60, 120).select("o_orderkey", "has_more").unionByName(_last_page(spark, d))
)
query("recent_runs", "select event_id, event_type from events order by ts desc, event_id desc limit 20")(lambda spark, d: ranking.recent(table(spark, d, "events"), "ts", "event_id", 20).select("event_id", "event_type"))


@query("rank_by_topic", """with b as (select doc_id, lower(split_part(text, chr(10), 1)) as t, lower(substr(text, 1, 4000)) as b from documents),
 s as (select doc_id, least(length(b) / 1000.0, 4.0) + 8 * ((length(t) - length(replace(t, 'tion', ''))) // 4) + (length(b) - length(replace(b, 'tion', ''))) // 4 + 8 * ((length(t) - length(replace(t, 'the', ''))) // 3) + (length(b) - length(replace(b, 'the', ''))) // 3 as lexical from b),
 r as (select s.doc_id, coalesce(cast(quality as double), 0) as outside, lexical, source from s left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id) join documents using (doc_id)),
 w as (select *, row_number() over (partition by lower(source) order by outside desc, lexical desc, doc_id) > 2 as late from r)
 select doc_id, outside, lexical from w order by late, outside desc, lexical desc, doc_id limit 30""")
def rank_by_topic(spark, d):
    scores = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("score"))
    ranked = ranking.rank_by_topic(table(spark, d, "documents"), F.substring_index("text", "\n", 1), F.col("text"), "tion the", "doc_id", scores)
    return windows.source_diverse_topk(ranked, 30).select("doc_id", "outside", "lexical")


@query("draft_listing", "select (select count(*) from orders where o_orderstatus = 'F') as total, o_orderkey as draft_id, case when trim(o_comment) <> '' then trim(o_comment) else o_clerk end as title, 'rewrite' as origin, strftime(cast(o_orderdate as timestamp) + interval 8 hours, '%Y-%m-%d %H:%M') as shown_at from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 60".replace("case when trim(o_comment) <> '' then trim(o_comment) else o_clerk end", "o_orderpriority"))
def draft_listing(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft_id"), F.lit(" ").alias("title_cn"), F.array("o_orderpriority").alias("title_candidates"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("origin"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return ranking.draft_listing(o, "F").select("total", "draft_id", "title", "origin", "shown_at")


# -- sets ----------------------------------------------------------------------------------------------------------------------------
@query("union_sources", "select doc_id, case when lang = 'en' then source end as source, lang from documents where lang in ('en', 'fr', 'de')")
def union_sources(spark, d):
    docs = table(spark, d, "documents")
    return sets.union_sources(docs.filter("lang = 'en'").select("doc_id", "source", "lang"), docs.filter("lang = 'fr'").select("doc_id", "lang"), docs.filter("lang = 'de'").select("doc_id", "lang"))


@query("upsert", """select s_suppkey, case when s_suppkey % 4 = 0 then 'new' else s_name end as s_name from supplier
 union all select s_suppkey + 1000000, 'new' from supplier where s_suppkey % 4 = 1""")
def upsert(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    news = s.filter("s_suppkey % 4 = 0").unionByName(s.filter("s_suppkey % 4 = 1").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)).withColumn("s_name", F.lit("new"))
    return sets.upsert(s, news, ["s_suppkey"])


@query("replace_group", """with t as (select conv_id, turn, role, conv_id % 5 = 0 as locked from conversations),
 f as (select conv_id, cast(row_number() over (partition by conv_id order by turn) as bigint) as turn, 'new' as role from t where conv_id % 2 = 0 and not locked and role = 'user')
 select conv_id, turn, role from t where conv_id not in (select conv_id from f)
 union all select * from f""")
def replace_group(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("conv_id") % 5 == 0, F.col("turn")).alias("draft_id"))
    rows = c.filter("conv_id % 2 = 0 and role = 'user'").withColumn("role", F.lit("new")).withColumn("draft_id", F.lit(None).cast("bigint"))
    return sets.replace_group(c, rows, "conv_id", "turn").select("conv_id", "turn", "role")


@query("added_count", "select count(*) as added from supplier where s_suppkey % 3 = 0")
def added_count(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return sets.added_count(s.filter("s_suppkey % 3 <> 0"), s, "s_suppkey")


@query("add_if_absent", "select s_suppkey, s_name from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, 'late' from supplier where s_suppkey % 3 = 0")
def add_if_absent(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return sets.add_if_absent(s.filter("s_suppkey % 3 <> 0"), s.withColumn("s_name", F.lit("late")), "s_suppkey")


# -- sinks ---------------------------------------------------------------------------------------------------------------------------
@query("archive_paths", f"""with {_P}, t as (select page_id, url, {_NORM} as u, regexp_replace(lower('Page ' || page_id || '!'), '[^a-z0-9\\s\\-]', '', 'g') as title, case when page_id % 3 = 0 then null else 'a/b' end as topic, timestamp '2024-01-01 00:00:00' + interval (page_id) hour as made_at from parts)
 select page_id, case when topic is null then 'uncategorized' else 'a_b' end || '/' || strftime(made_at, '%Y%m%d') || '-' || case when page_id % 7 = 0 then 'untitled-' || substr(sha256(u), 1, 8) else substr(replace(title, ' ', '-'), 1, 60) end as archive_path from t""")
def archive_paths(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 7 == 0, "!!").otherwise(F.concat(F.lit("Page "), "page_id", F.lit("!"))).alias("title"), F.when(F.col("page_id") % 3 != 0, "a/b").alias("topic"), F.lit(None).cast("timestamp").alias("published_at"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("fetched_at"))
    return io.with_archive_path(p).select("page_id", "archive_path")


query("failure_tail", "select event_id, substr(props, 1, 200) as snippet from events where event_type = 'error' order by ts desc, event_id desc limit 10000")(
    lambda spark, d: io.failure_tail(io.failure_records(table(spark, d, "events").filter("event_type = 'error'").withColumn("response_snippet", F.col("props"))), at="ts", tie="event_id").select("event_id", F.col("response_snippet").alias("snippet"))
)


@query(
    "compile_series",
    rf"""with c as (select conv_id as series_id, turn as chapter_order, role || ' ' || turn as title, coalesce(text, '') as body from conversations),
 k as (select series_id * 1000 + chapter_order as key, * from c),
 {_lines_sql('k', 'body', 'key')}, b as (select key, string_agg(case when not fenced and regexp_matches(line, '^#{{1,5}}\s') then '#' || line else line end, chr(10) order by line_no) as body from l group by 1),
 f as (select k.*, b.body || case when chapter_order % 2 = 0 then chr(10) || chr(10) || '### Sources' || chr(10) || chr(10) || '1. [' || title || '](https://one.example/' || series_id || ')' || chr(10) || '2. [two](https://two.example/)' else '' end as full_body from k join b using (key))
 select series_id, '# Series ' || series_id || chr(10) || chr(10) || string_agg('- ' || title, chr(10) order by chapter_order) || chr(10) || chr(10) || case when series_id % 2 = 0 then '- outline' || chr(10) || chr(10) else '' end
  || string_agg('## ' || title || chr(10) || chr(10) || full_body, chr(10) || chr(10) order by chapter_order) as document from f group by series_id""",
)
def compile_series(spark, d):
    """A document for each conversation; every second chapter has two sources, every second series an outline."""
    c = _chapters(spark, d)
    series = c.select("series_id").distinct()
    cited = c.filter("chapter_order % 2 = 0").select("series_id", "chapter_order", F.explode(F.array(F.struct(F.lit(2).alias("no"), F.lit("two").alias("title"), F.lit("https://two.example/").alias("url")), F.struct(F.lit(1).alias("no"), "title", F.concat(F.lit("https://one.example/"), "series_id").alias("url")))).alias("s")).select("series_id", "chapter_order", "s.*")
    outlines = series.filter("series_id % 2 = 0").withColumn("outline", F.lit("- outline"))
    return io.compile_series(series.withColumn("topic", F.concat(F.lit("Series "), "series_id")), c, sources=cited, outlines=outlines)


@query(
    "delete_series",
    """select (select count(*) from customer where c_nationkey = 3) as series, (select count(*) from orders join customer on o_custkey = c_custkey where c_nationkey = 3) as drafts,
 (select count(*) from conversations join customer on conv_id = c_custkey where c_nationkey = 3) as chapters""",
)
def delete_series(spark, d):
    """How much goes with the series of one nation: customers as series, their orders as drafts, conversations as chapters."""
    series = table(spark, d, "customer").select(F.col("c_custkey").alias("series_id"), "c_nationkey")
    drafts = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("series_id"))
    chapters = table(spark, d, "conversations").select(F.col("conv_id").alias("series_id"), "turn")
    return joins.delete_series(series, drafts, chapters, series.filter("c_nationkey = 3"))[3]


@query("backfill_flags", "select doc_id, case doc_id % 3 when 0 then doc_id % 2 = 1 when 1 then false else true end as has_video from documents")
def backfill_flags(spark, d):
    """A third of the documents without the flag, half of these with a film's address behind the text. (No text has such an address itself.)"""
    from gleanings.streaming import streams

    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 1, " https://youtu.be/x").otherwise(""))
    flag = F.expr("case doc_id % 3 when 1 then false when 2 then true end")
    rows = table(spark, d, "documents").select("doc_id", body.alias("body"), F.array().cast("array<string>").alias("videos"), flag.alias("has_video"))
    return streams.backfill_flags(rows).select("doc_id", "has_video")
