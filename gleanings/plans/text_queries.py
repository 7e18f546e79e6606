"""Queries over texts: lines, phrases, replies, graphs, dates and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanings.functions import dates
from gleanings.functions import text as T
from gleanings.operators import quality
from gleanings.plans.registry import query
from gleanings.session import table
from gleanings.streaming import batch_twins

def _marked(spark, d):
    """Documents of which a third begin with a heading, a fence and a directive, and a fifth end with references."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Head\n```\n# code the code — x\n```\n:::note\n## Two\n"), F.col("text"))).otherwise(F.col("text"))
    return docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(fenced, F.lit("\n\n---\n\n## References\n- one\n- two"))).otherwise(fenced))


#: The same in SQL: m (doc_id, text), its split at the last heading of references, s (doc_id, text, body, tail), and lines with fences by a running count.
_M = """m as (select doc_id, case when doc_id % 3 = 0 then '# Head' || chr(10) || '```' || chr(10) || '# code the code — x' || chr(10) || '```' || chr(10) || ':::note' || chr(10) || '## Two' || chr(10) else '' end
 || coalesce(text, '') || case when doc_id % 5 = 0 then chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## References' || chr(10) || '- one' || chr(10) || '- two' else '' end as text from documents)"""
_HEAD = rf"#{{1,6}}[ \t]*(?:{'|'.join(T.REFERENCE_NAMES)})[ \t]*:?[ \t]*"
_SPLIT = rf"""s0 as (select *, regexp_matches(text, '(?im)^{_HEAD}$') as has, regexp_replace(regexp_extract(text, '(?is)^(.*\n|){_HEAD}(?:\n.*)?$', 1), '(^|\n)[ \t]*(?:-{{3,}}|\*{{3,}})[ \t]*\n\s*$', '\1') as front from m),
 s as (select doc_id, text, case when has then front else text end as body, case when has then substr(text, length(front) + 1) else '' end as tail from s0)"""


def _lines_sql(of: str, column: str = "body", key: str = "doc_id") -> str:
    """CTEs ending in l (key, line_no, line, fenced) over a table's bodies."""
    return rf"""l0 as (select {key}, unnest(string_split({column}, chr(10))) as line, generate_subscripts(string_split({column}, chr(10)), 1) as line_no from {of}),
 l1 as (select *, regexp_matches(line, '^\s*(```|~~~)') as fence from l0),
 l as (select {key}, line_no, line, fence or coalesce(sum(fence::int) over (partition by {key} order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as fenced from l1)"""


_BLANK = r"regexp_replace(regexp_replace(regexp_replace(line, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), 'https?://[^\s)]+', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_PROSE = rf"{_M}, {_SPLIT}, {_lines_sql('s')}, p as (select doc_id, line_no, {_BLANK} as line from l where not fenced and not regexp_matches(line, '^\s*:::'))"


@query("prose_lines", f"with {_PROSE} select doc_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars, cast(sum(line_no) as bigint) as places from p group by 1")
def prose_lines(spark, d):
    found = T.prose_lines(_marked(spark, d))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.sum("line_no").alias("places"))


@query("split_references", f"with {_M}, {_SPLIT} select doc_id, md5(body) as body_md5, md5(tail) as tail_md5, body || tail = text as whole from s")
def split_references(spark, d):
    body, tail = T.split_references(F.col("text"))
    return _marked(spark, d).select("doc_id", F.md5(body).alias("body_md5"), F.md5(tail).alias("tail_md5"), (F.concat(body, tail) == F.col("text")).alias("whole"))


@query("restore_references", r"""with d as (select doc_id, coalesce(text, '') as t from documents)
 select doc_id, md5(case when doc_id % 5 = 0 then regexp_replace(t, '\s+$', '') || chr(10) || chr(10) || '## References' || chr(10) || '- one' else t || chr(10) || '## Sources' || chr(10) || 'own' end) as body_md5 from d where not regexp_matches(t, '(?im)^#{1,6}[ \t]*(?:References|Reference|Sources|Bibliography)')""")
def restore_references(spark, d):
    """Rewritten bodies with a list of their own; where the original has one, that one counts. (No document has such a heading itself.)"""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    original = F.when(F.col("doc_id") % 5 == 0, F.concat("t", F.lit("\n\n## References\n- one"))).otherwise(F.col("t"))
    return docs.select("doc_id", F.md5(T.restore_references(F.concat("t", F.lit("\n## Sources\nown")), original)).alias("body_md5"))


#: Words of the Latin test texts in two categories, one with endings that exempt it and one that an ordinal behind it exempts.
CATEGORIES = {"adlaw": [T.Word("pathetic"), T.Word("the", ("re", "m"))], "marketing": [T.Word("disgusting"), T.Word("first", (), "second|third", 20)]}
_PLAIN_WORDS = [T.Word(w) for w in ("pathetic", "disgusting", "idiot")]
_REMOVED = "regexp_replace(regexp_replace(regexp_replace(text, 'disgusting', '', 'g'), 'pathetic', '', 'g'), 'idiot', '', 'g')"


@query("sanitize", f"select doc_id, md5({_REMOVED}) as body_md5, len(regexp_extract_all(text, 'idiot')) as n_idiot from documents")
def sanitize(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.sanitize(F.col("text"), _PLAIN_WORDS)).alias("body_md5"), F.regexp_count("text", F.lit("idiot")).cast("bigint").alias("n_idiot"))


@query(
    "sanitize_hits",
    """with a as (select doc_id, text as t0 from documents),
 b as (select *, replace(t0, 'disgusting', '') as t1 from a),
 c as (select *, replace(t1, 'pathetic', '') as t2 from b),
 h as (select doc_id, 'disgusting' as word, (length(t0) - length(t1)) // 10 as count, strpos(t0, 'disgusting') - 1 as pos from c
 union all select doc_id, 'pathetic', (length(t1) - length(t2)) // 8, strpos(t1, 'pathetic') - 1 from c
      
 union all select doc_id, 'idiot', (length(t2) - length(replace(t2, 'idiot', ''))) // 5, strpos(t2, 'idiot') - 1 from c)
 select doc_id, word, cast(count as bigint) as count, cast(pos as bigint) as pos from h where count > 0""",
)
def sanitize_hits(spark, d):
    hits = table(spark, d, "documents").select("doc_id", F.explode(T.sanitize_hits(F.col("text"), _PLAIN_WORDS)).alias("h"))
    return hits.select("doc_id", "h.word", "h.count", "h.pos")


@query("sanitize_exceptions", r"""with a as (select doc_id, coalesce(text, '') as t0 from documents),
 b as (select doc_id, replace(replace(t0, 'disgusting', ''), 'pathetic', '') as t from a),
 w as (select doc_id, replace(replace(t, 'there', 'th' || chr(1) || 're'), 'them', 'th' || chr(1) || 'm') as t from b)
 select doc_id, md5(replace(replace(replace(t, 'own', ''), 'the', ''), chr(1), 'e')) as body_md5 from w""")
def sanitize_exceptions(spark, d):
    """The words of a level, with a word's exempted endings, and a word of one's own. (No text has "first" before an ordinal.)"""
    words = T.lexicon({**CATEGORIES, "marketing": CATEGORIES["marketing"][:1]}, "standard", "own")
    return table(spark, d, "documents").select("doc_id", F.md5(T.sanitize(F.coalesce("text", F.lit("")), words)).alias("body_md5"))


PHRASES = [(r"(?m)^Licensed under [^\n]*$", ""), (r"(?m)^This work is licensed [^\n]*$", ""), (r" {2,}", " ")]


@query(
    "strip_phrases",
    r"""with a as (select doc_id, regexp_replace(regexp_replace(text, '(?m)^Licensed under [^\n]*$', '', 'g'), '(?m)^This work is licensed [^\n]*$', '', 'g') as t from documents)
 select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+', '')) as body_md5 from a""",
)
def strip_phrases(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_phrases(F.col("text"), PHRASES)).alias("body_md5"))


_DASH = "(?:—+|–+|--+)"
_DASHES = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\s*{_DASH}\s*([。！？.!?;；])', '\1', 'g'), '([。！？.!?;；，,])\s*{_DASH}\s*', '\1', 'g'), '\s*{_DASH}\s*$', ''), '\s*{_DASH}\s*', '，', 'g')"""
_DASHED = "chr(10) || 'x — and -- y—. z, – a —' || chr(10) || '> — someone' || chr(10) || '---' || chr(10) || '| a -- b |' || chr(10) || '~~~' || chr(10) || 'a—b' || chr(10) || '~~~' || chr(10) || 'end—of it'"


@query(
    "normalize_dashes",
    rf"""with m as (select doc_id, coalesce(text, '') || {_DASHED} as body from documents), {_lines_sql('m')},
 n as (select *, case when fenced or regexp_matches(line, '^\s*>?\s*{_DASH}') or regexp_matches(line, '^\s*(?:-{{3,}}|\|.*\|)\s*$') then line else {_DASHES} end as new from l)
 select doc_id, md5(string_agg(new, chr(10) order by line_no)) as body_md5 from n group by 1""",
)
def normalize_dashes(spark, d):
    """Whole texts, with lines added that have dashes of every kind."""
    more = "\nx — and -- y—. z, – a —\n> — someone\n---\n| a -- b |\n~~~\na—b\n~~~\nend—of it"
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_dashes(F.concat(F.coalesce("text", F.lit("")), F.lit(more)))).alias("body_md5"))


@query(
    "first_paragraph",
    r"""with k as (select doc_id, unnest(string_split_regex(text, '\n\s*\n')) as block, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) as n from documents),
 c as (select doc_id, n, array_to_string(list_filter(string_split(block, chr(10)), lambda s: not regexp_matches(s, '^\s*(#|!\[|>|\||-{3,}\s*$|\*{3,}\s*$)') and not regexp_matches(s, '^\s*$')), ' ') as x from k),
 p as (select doc_id, n, trim(regexp_replace(regexp_replace(x, '\[\d+\]', '', 'g'), '\s+', ' ', 'g')) as x from c),
 f as (select doc_id, arg_min(x, n) as x from p where x <> '' group by 1)
 select doc_id, coalesce(substr(x, 1, 200), '') as paragraph from documents left join f using (doc_id)""",
)
def first_paragraph(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_paragraph(F.col("text")).alias("paragraph"))


@query("demote_headings", rf"with {_M}, {_lines_sql('m', 'text')} select doc_id, md5(string_agg(case when not fenced and regexp_matches(line, '^#{{1,5}}\s') then '#' || line else line end, chr(10) order by line_no)) as body_md5 from l group by 1")
def demote_headings(spark, d):
    return _marked(spark, d).select("doc_id", F.md5(T.demote_headings(F.col("text"))).alias("body_md5"))


@query("strip_nav", "select doc_id, md5(case when doc_id % 2 = 0 then coalesce(text, '') else '> Part of another' || chr(10) || coalesce(text, '') end) as body_md5 from documents where not starts_with(coalesce(text, ''), '>') and not starts_with(coalesce(text, ''), chr(10))")
def strip_nav(spark, d):
    """Bodies with a navigation quote in front, and with another quote, which stays. (No text begins with a quote or a line end.)"""
    front = F.when(F.col("doc_id") % 2 == 0, F.lit("> This is part 2 of 3\n> before: x\n\n")).otherwise(F.lit("> Part of another\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_nav(F.concat(front, F.coalesce("text", F.lit(""))), "This is part")).alias("body_md5"))


# Chinese queries in front of the items, and how they are cut (stated, because DuckDB has no pattern that looks around).
_CASES = [
    ("水印以及甲与识别", ("水印", "甲", "识别")),
    ("甲乙与丙和丁戊", ("甲乙", "丙", "丁戊")),
    ("参与目的的确定", ("参与目的的确定",)),
    ("大模型水印的识别与去除技术", ("大模型水印", "识别", "去除")),
    ("方法，methods、总结", ()),
    ("量子计算机硬件与软件工程师的培训班", ("量子计算机硬件", "软件工程师", "培训班")),
    ("安全与和平以及目的地和的士站", ("安全", "和平", "目的地", "的士站")),
    ("", ()),
]
_ASKED_SQL = f"""c(i, zh, cuts) as (values {", ".join(f"({i}, '{q}', {list(cuts)}::varchar[])" for i, (q, cuts) in enumerate(_CASES))}),
 w as (select item_id, zh || ' ' || text as q, list_filter(list_concat(cuts, string_split_regex(trim(text), '[\\s、,，/|]+')), lambda x: x <> '' and lower(x) not in ('techniques', 'technique', 'methods', 'method', 'approaches', 'approach')) as l from benchmark join c on i = item_id % {len(_CASES)}),
 t as (select item_id, q, list_filter(l, lambda x, i: list_position(l, x) = i) as ts from w)"""
_CUT_SQL = "len(list_filter(range(1, 4), lambda k: k = 1 or (k <= len(ts) and length(regexp_replace(array_to_string(ts[1:k], ''), '[^一-鿿]', '', 'g')) <= 10)))"


def _asked(spark, d):
    zh = F.element_at(F.array(*[F.lit(q) for q, _ in _CASES]), (F.col("item_id") % len(_CASES) + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.concat(zh, F.lit(" "), "text").alias("q"))


@query("query_terms", f"with {_ASKED_SQL} select item_id, array_to_string(ts, ' ') as terms from t")
def query_terms(spark, d):
    return _asked(spark, d).select("item_id", F.array_join(T.query_terms(F.col("q")), " ").alias("terms"))


@query("atomize_query", f"with {_ASKED_SQL} select item_id, array_to_string(case when regexp_matches(q, '[一-鿿]') then ts[1:{_CUT_SQL}] else ts[1:5] end, ' ') as query from t")
def atomize_query(spark, d):
    return _asked(spark, d).select("item_id", T.atomize_query(F.col("q")).alias("query"))


@query(
    "query_rounds",
    f"""with {_ASKED_SQL},
 r as (select item_id, q from t union select item_id, array_to_string(ts[1:len(ts) - 1], ' ') from t where len(ts) > 1 union select item_id, array_to_string(ts[1:len(ts) - 2], ' ') from t where len(ts) > 2)
 select item_id, q as query from r""",
)
def query_rounds(spark, d):
    """Every query with up to two shortened forms."""
    return _asked(spark, d).select("item_id", F.explode(T.query_rounds(F.col("q"))).alias("query"))


_TOPIC = "case item_id % 4 when 0 then text || '？水印 到底怎么样？' when 1 then text when 2 then '到真的底好，' || text else '为什么' end"
_SEPARATED = "trim(regexp_replace(regexp_replace(t, '[,，。、！？!?;；：:]', ' ', 'g'), '\\s+', ' ', 'g'))"
_MANNERLESS = f"regexp_replace(x, '{'|'.join(T.MANNER_WORDS)}', '', 'g')"


@query(
    "topic_terms",
    f"""with b as (select item_id, {_TOPIC} as t from benchmark),
 s as (select item_id, t, {_SEPARATED} as s, regexp_matches(t, '[一-鿿]') as zh from b),
 k as (select *, array_to_string(list_filter(list_transform(string_split(s, ' '), lambda x: regexp_replace({_MANNERLESS}, '(?:{'|'.join(T.QUESTION_TAILS)})$', '')), lambda x: x <> ''), ' ') as k from s)
 select item_id, case when not zh then s when k <> '' then k when s <> '' then s else t end as terms, case when zh then 'zh' else 'en' end as region from k""",
)
def topic_terms(spark, d):
    """Every item as a topic: as it is, with a Chinese question behind it, with a word of manner inside another, or nothing but a question's ending."""
    t = F.expr(_TOPIC)
    return table(spark, d, "benchmark").select("item_id", T.topic_terms(t).alias("terms"), T.region(t).alias("region"))


@query("fallback_queries", "select item_id, q as query from benchmark, unnest([text, text || ' 分析', text || ' 专家 建议', text || ' research', text || ' expert analysis']) t(q)")
def fallback_queries(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.fallback_queries(F.col("text"))).alias("query"))


@query("parse_reply", "select event_id, case when event_id % 4 <> 3 then cast(regexp_extract(props, '\"k\": *(\\d+)', 1) as bigint) end as k from events")
def parse_reply(spark, d):
    """Replies that are JSON, hold it in a fence or in a sentence, or are unreadable, which gives null."""
    reply = F.expr("case event_id % 4 when 0 then props when 1 then concat('Sure:\n```json\n', props, '\n```\nbye') when 2 then concat('I think ', props, ' is right') else 'no' end")
    return table(spark, d, "events").select("event_id", T.parse_reply(reply, "k bigint", "k").alias("r")).select("event_id", "r.k")


@query("rescue_fields", "select doc_id, md5(coalesce(text, '')) as body_md5, case when doc_id % 2 = 0 then 'in short' else '' end as digest from documents")
def rescue_fields(spark, d):
    """Replies with whole texts as a field, cut off before the object ends: read one field at a time."""
    escaped = F.replace(F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    reply = F.concat(F.lit('{"body_md": "'), escaped, F.lit('", '), F.when(F.col("doc_id") % 2 == 0, F.lit('"digest": "in short", ')).otherwise(F.lit("")), F.lit('"rest": [1, '))
    fields = table(spark, d, "documents").select("doc_id", T.rescue_fields(reply, ("body_md", "digest")).alias("f"))
    field = lambda n: F.coalesce(F.try_element_at("f", F.lit(n)), F.lit(""))
    return fields.select("doc_id", F.md5(field("body_md")).alias("body_md5"), field("digest").alias("digest"))


_SAID = "case (conv_id + turn) % 6 when 0 then '' when 1 then '### Head' || chr(10) || 'x' when 2 then chr(10) || ' tHinking, ' || text when 3 then text || chr(10) || 'a ## b' else text end"


@query(
    "leaked_reasoning",
    rf"""with s as (select conv_id, turn, regexp_replace({_SAID}, '^\s+|\s+$', '', 'g') as t from conversations),
 l as (select *, list_filter(string_split(t, chr(10)), lambda s: not regexp_matches(s, '^\s*$')) as ls from s)
 select conv_id, turn, t <> '' and (starts_with(lower(ls[1]), 'th') or (len(ls) < 10 and not contains(t, '## '))) as leaked from l""",
)
def leaked_reasoning(spark, d):
    """Every turn; some empty, some with a heading of the third level, a marker in other case, or the sign of a heading inside a line."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.leaked_reasoning(F.expr(_SAID.replace("chr(10)", "char(10)")), ["Th"]).alias("leaked"))


@query("knowledge_edges", "select distinct 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union select 'world', 'r' || r_regionkey from region")
def knowledge_edges(spark, d):
    """One line of a text graph for each nation: a chain from the world over its region, with a caption, and a loop to be dropped."""
    graph = table(spark, d, "nation").select(F.concat(F.lit("world -->|has| r"), "n_regionkey", F.lit(" --> n"), "n_nationkey", F.lit("[Nation]\n"), F.lit("world --> world")).alias("g"))
    regions = table(spark, d, "region").select(F.concat(F.lit("world --> r"), "r_regionkey").alias("g"))
    return graph.unionByName(regions).select(F.explode(T.edges_of(F.col("g"))).alias("e")).select("e.src", "e.dst").distinct()


def _paths(edges, deepest: int = 4):
    """path (labels from the top, as an array) of every node that a top reaches over edges (src, dst), no node twice on a path."""
    tops = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    level = tops.select("node", F.array("node").alias("path"))
    found = level
    for _ in range(deepest):
        level = level.join(edges, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        found = found.unionByName(level)
    return found


@query("knowledge_outline", """select 'world/r' || n_regionkey || '/n' || n_nationkey as path, 2 as depth from nation
 union all select 'world/r' || r_regionkey, 1 from region
 union all select 'world', 0""")
def knowledge_outline(spark, d):
    return _paths(knowledge_edges(spark, d)).select(F.array_join("path", "/").alias("path"), (F.size("path") - 1).alias("depth"))


@query(
    "knowledge_outline_text",
    """with p as (select ['world', 'r' || n_regionkey, 'n' || n_nationkey] as path from nation
 union all select ['world', 'r' || r_regionkey] from region
 union all select ['world'])
 select 1 as graph_id, string_agg(repeat('  ', len(path) - 1) || '- ' || path[-1], chr(10) order by path) as outline from p""",
)
def knowledge_outline_text(spark, d):
    return T.outline_text(_paths(knowledge_edges(spark, d)).select(F.lit(1).alias("graph_id"), "path"))


query("parse_date", "select o_orderkey, cast(o_orderdate as timestamp) as parsed from orders")(
    lambda spark, d: table(spark, d, "orders").select(
        "o_orderkey",
        dates.parse_date(F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "MMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd", "yyyy年M月d日", "MM/dd/yyyy", "EEE, d MMM yyyy HH:mm:ss 'GMT'")]), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("parsed"),
    )
)
@query(
    "sample_quality",
    """with g as (select conv_id, count(*) as n, count(*) filter (where length(coalesce(text, '')) < 100) as short, count(*) filter (where turn % 6 = 5) as closed from conversations group by 1)
 select conv_id as style_id, n, array_to_string(list_filter(['too few', 'too many', 'too short', 'url not public'], lambda x, i: [n < 3, n > 10, short > 0, closed > 0][i]), ',') as violations, n between 3 and 10 and short = 0 and closed = 0 as ok from g""",
)
def sample_quality(spark, d):
    """The turns of a conversation as samples of a style; every sixth has a local address."""
    c = table(spark, d, "conversations")
    found = T.sample_quality(c.select(F.col("conv_id").alias("style_id"), F.when(F.col("turn") % 6 == 5, "http://localhost/x").otherwise("https://public.example/x").alias("url"), "text"))
    return found.select("style_id", "n", F.array_join("violations", ",").alias("violations"), "ok")


_LINK = r"(^|[^!])\[([^\]]*)\]\(\s*https?://[^)]*\)"


@query("strip_external_links", rf"""with b as (select doc_id, coalesce(text, '') || ' [a](http://x.example/y)[c](https://x.example) b ![i](http://x.example/z.png) [in](#here)' as t from documents)
 select doc_id, md5(regexp_replace(regexp_replace(t, '{_LINK}', '\1\2', 'g'), '{_LINK}', '\1\2', 'g')) as body_md5 from b""")
def strip_external_links(spark, d):
    """Whole texts with links, two of them side by side, a picture and an inner link added. (The second pass of the SQL is for neighbours.)"""
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" [a](http://x.example/y)[c](https://x.example) b ![i](http://x.example/z.png) [in](#here)"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_external_links(body)).alias("body_md5"))


def _peeled_sql(t: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace({t}, '(?i)^(?:digest|summary|摘要|导语)\s*[:：]\s*', ''), '^["''“”‘’「」]+|["''“”‘’「」]+$', '', 'g'))"""


@query("clean_digest", rf"""with a as (select doc_id, trim(regexp_replace('Summary: "' || coalesce(text, '') || '"', '\s+', ' ', 'g')) as t from documents),
 b as (select doc_id, {_peeled_sql('t')} as t from a),
 c as (select doc_id, {_peeled_sql('t')} as t from b)
 select doc_id, substr({_peeled_sql('t')}, 1, 120) as digest from c""")
def clean_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_digest(F.concat(F.lit('Summary: "'), F.coalesce("text", F.lit("")), F.lit('"'))).alias("digest"))


@query("strip_prompt_blocks", r"select doc_id, md5(regexp_replace(coalesce(text, '') || chr(10) || 'end', '\n{3,}', chr(10) || chr(10), 'g')) as body_md5 from documents")
def strip_prompt_blocks(spark, d):
    """Whole texts with a block to be dropped in front of a last line."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_prompt_blocks(F.concat(F.coalesce("text", F.lit("")), F.lit("\n:::image-prompt\na cat\n:::\nend")))).alias("body_md5"))


_TABLE = "'intro' || chr(10) || '| a | b |' || chr(10) || chr(10) || chr(10) || '| ' || turn || ' | x |' || chr(10) || 'after' || chr(10) || chr(10) || coalesce(text, '')"


@query(
    "compact_tables",
    rf"""with m as (select conv_id * 1000 + turn as doc_id, {_TABLE} as body from conversations), {_lines_sql('m')},
 r as (select *, contains(line, '|') as has, regexp_matches(line, '^\s*$') as blank from l),
 k as (select *, case when not blank then has end as near from r),
 n as (select *, last_value(near ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as before, first_value(near ignore nulls) over (partition by doc_id order by line_no rows between 1 following and unbounded following) as after,
       coalesce(lag(blank) over (partition by doc_id order by line_no), true) as gap_before, coalesce(lead(blank) over (partition by doc_id order by line_no), true) as gap_after from k),
 o as (select doc_id, line_no, case when has and not coalesce(before, false) and not gap_before then chr(10) else '' end || line || case when has and not coalesce(after, false) and not gap_after then chr(10) else '' end as line from n where not (blank and coalesce(before, false) and coalesce(after, false)))
 select doc_id, md5(string_agg(line, chr(10) order by line_no)) as body_md5 from o group by 1""",
)
def compact_tables(spark, d):
    """Every turn's text behind a table with a gap in it."""
    body = F.concat(F.lit("intro\n| a | b |\n\n\n| "), "turn", F.lit(" | x |\nafter\n\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.md5(T.compact_tables(body)).alias("body_md5"))


@query("outline_rows", """with c as (select conv_id, turn, role || ' ' || turn as title, row_number() over (partition by conv_id order by turn) as n from conversations where turn % 3 <> 1)
 select conv_id as series_id, n as chapter_order, title, case when turn % 2 = 0 then 'spark ' || title else 'alpha beta' end as queries from c where n <= 4""")
def outline_rows(spark, d):
    """Replies that list a series' turns as chapters; every third has no title and goes."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.struct(F.when(F.col("turn") % 3 != 1, F.concat_ws(" ", "role", "turn")).otherwise(" ").alias("title"), F.lit("s").alias("scope"), F.when(F.col("turn") % 2 == 1, F.array(F.lit("alpha beta"), F.lit("alpha beta"))).otherwise(F.array().cast("array<string>")).alias("queries")).alias("x"))
    chapters = F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda p: p["x"])
    replies = c.groupBy(F.col("conv_id").alias("series_id")).agg(F.concat(F.lit("Here it is: "), F.to_json(F.struct(chapters.alias("chapters"))), F.lit(" Done.")).alias("reply"))
    return T.outline_rows(replies, 4, "spark").select("series_id", "chapter_order", "title", F.array_join("queries", ",").alias("queries"))


@query(
    "clean_output",
    r"""with a as (select conv_id, turn, text, case when turn % 2 = 0 then 'Here it is:' || chr(10) || '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || text || chr(10) || '## Notes' || chr(10) || 'mine' else '```markdown' || chr(10) || text || chr(10) || '```' end as t from conversations),
 b as (select *, case when starts_with(t, '---' || chr(10)) then t else regexp_replace(t, '(?s)^.*?\n(---\n[A-Za-z_]+\s*:)', '\1') end as u from a),
 c as (select *, regexp_replace(u, '(?s)^\s*```(?:markdown|md)?\n(.*)\n```\s*$', '\1') as v from b)
 select conv_id, turn, md5(case when starts_with(text, 'Th') then text else regexp_replace(v, '(?is)\n+(?:---\n+)?#{1,6}\s*(?:notes?|说明|备注)\s*\n.*$', '') end) as body_md5 from c""",
)
def clean_output(spark, d):
    """Every turn's text as an answer: behind a remark, in front of notes, or in a fence; those of leaked reasoning stay as they were."""
    c = table(spark, d, "conversations")
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here it is:\n---\ntitle: x\n---\n"), "text", F.lit("\n## Notes\nmine"))).otherwise(F.concat(F.lit("```markdown\n"), "text", F.lit("\n```")))
    return c.select("conv_id", "turn", F.md5(F.when(F.startswith("text", F.lit("Th")), F.col("text")).otherwise(T.clean_output(reply))).alias("body_md5"))


query("normalize_tags", "select p_partkey, '#' || replace(p_type, ' ', '') || ' #' || replace(p_brand, '#', ' #') as tags from part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", T.normalize_tags(F.concat(F.lit("Tags: "), "p_type", F.lit("、"), "p_brand", F.lit("，"), "p_type")).alias("tags"))
)

# -- scores --------------------------------------------------------------------------------------------------------------------------
HOT = ["tion the", "licensed"]
_NOW = "timestamp '2024-01-20 00:00:00'"


def _dated(spark, d):
    return table(spark, d, "documents").withColumn("seen_at", F.lit("2024-01-20").cast("timestamp") - F.make_dt_interval(hours=(F.col("doc_id") * 7 % 600).cast("int")))


def _score(spark, d):
    rows = _dated(spark, d).join(table(spark, d, "labels").filter("toxic = 1").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id", "left")
    outside = F.when(F.col("q").isNotNull(), F.col("q") * 100.0)
    return rows.select("doc_id", "text", quality.heuristic_score(F.substring_index("text", "\n", 1), F.col("source"), F.col("text"), F.col("seen_at"), F.lit("2024-01-20").cast("timestamp"), HOT, outside).alias("score"))


_SCORE_SQL = """with d as (select doc_id, text, source, lower(split_part(text, chr(10), 1)) as t, length(split_part(text, chr(10), 1)) as m, length(text) as n, floor((doc_id * 7 % 600) / 24) as days from documents),
 l as (select doc_id, max(quality) as q from labels where toxic = 1 group by 1),
 s as (select d.doc_id, q, 50 + case when contains(t, 'tion the') or contains(t, 'licensed') then 10 else 0 end + case when days <= 1 then 20 when days <= 3 then 15 when days <= 7 then 10 when days <= 14 then 5 else 0 end + case when n > 2000 then 10 when n > 1000 then 5 when n < 100 then -10 else 0 end + case when m >= 15 then 5 when m < 5 then -5 else 0 end as own from d left join l using (doc_id))
 select doc_id, cast(coalesce(q * 100.0, least(100, greatest(0, own))) as double) as score from s"""
query("draft_score", _SCORE_SQL)(lambda spark, d: _score(spark, d).select("doc_id", "score"))

#: Small style dimensions of our own for the Latin test tables.
DIMENSIONS = [quality.Dimension("shout", 12.0, 2.5, ("!!",)), quality.Dimension("licence", 20.0, 1.0, ("[Ll]icensed under", "All rights reserved")), quality.Dimension("filler", 8.0, 30.0, (" the ", " und "))]
_CHARS = r"regexp_replace(regexp_replace(line, '[*_`>#\[\]()~|\-]+', '', 'g'), '\s', '', 'g')"
_PLAIN = f"p as (select doc_id, {_BLANK} as line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents))"
_HITS = r"len(regexp_extract_all(line, '!!')) as shout, len(regexp_extract_all(line, '[Ll]icensed under')) + len(regexp_extract_all(line, 'All rights reserved')) as licence, len(regexp_extract_all(line, ' the ')) + len(regexp_extract_all(line, ' und ')) as filler"
_POINTS = f"""with {_PLAIN}, h as (select doc_id, length({_CHARS}) as chars, {_HITS} from p),
 g as (select doc_id, sum(chars) as chars, sum(shout) as shout, sum(licence) as licence, sum(filler) as filler from h group by 1),
 u as (select doc_id, chars, 'shout' as dimension, 12.0 as w, 2.5 as s, shout as hits from g
 union all select doc_id, chars, 'licence', 20.0, 1.0, licence from g
 union all select doc_id, chars, 'filler', 8.0, 30.0, filler from g)"""
query("flavor_score", f"{_POINTS} select doc_id, dimension, cast(hits as bigint) as hits, round(cast(case when hits = 1 then least(w * least(1, hits * (1000.0 / greatest(chars, 800)) / s), w * 0.3) else w * least(1, hits * (1000.0 / greatest(chars, 800)) / s) end as double), 6) as points from u where hits > 0")(
    lambda spark, d: quality.flavor_points(table(spark, d, "documents").select("doc_id", "text"), DIMENSIONS).select("doc_id", "dimension", "hits", F.round("points", 6).alias("points"))
)
query("rhythm", rf"""with {_PLAIN.replace('unnest(string_split(text, chr(10))) as line', 'text as line')}, s as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(line, '[*_`>#\[\]()~|\-]+', '', 'g'), '[.!?]+'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda n: n >= 4) as n from p)
 select doc_id, len(n) as sentences, round(case when len(n) < 8 or list_stddev_pop(n) / list_avg(n) >= 0.62 then 0 else 10 * (0.62 - greatest(list_stddev_pop(n) / list_avg(n), 0.30)) / 0.32 end, 4) as points from s""")(
    lambda spark, d: quality.rhythm(table(spark, d, "documents").select("doc_id", "text"), enders=".!?").select("doc_id", "sentences", F.round("points", 4).alias("points"))
)


_MAIL = r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)"


@query(
    "diversion_scan",
    rf"""with d as (select doc_id, coalesce(text, '') as t from documents),
 l0 as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as line_no from d),
 m as (select doc_id, 'body' as part, line_no, 'contact_id' as kind, regexp_extract(line, '{_MAIL}', 1) as found from l0 where regexp_matches(line, '{_MAIL}'))
 select doc_id, part, line_no + case when doc_id % 50 = 0 then 6 else 0 end as line_no, kind, found from m
 union all select doc_id, 'body', 1, 'external_link', 'https://out.example/' || doc_id from documents where doc_id % 50 = 0
 union all select doc_id, 'body', 2, 'qr_image', 'https://h.example/a.png' from documents where doc_id % 50 = 0
 union all select doc_id, 'title', 1, 'external_link', 'https://title.example' from documents where doc_id % 50 = 0
 union all select doc_id, 'footer', 1, 'external_link', 'https://foot.example/x' from documents where doc_id % 50 = 0""",
)
def diversion_scan(spark, d):
    """Whole texts; some with links (one to a film), a picture under a word that tells a code, a fence, a title and a footer that repeats one link."""
    front = F.concat(F.lit("see (https://out.example/"), "doc_id", F.lit("). https://v.qq.com/x\n![](https://h.example/a.png)\nplease 扫码\n```\nhttps://fenced.example\n```\n"))
    some = F.col("doc_id") % 50 == 0
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.when(some, front).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"),
        F.when(some, "at https://title.example").alias("title"),
        F.when(some, F.concat(F.lit("https://foot.example/x https://out.example/"), "doc_id")).alias("foot"),
    )
    return quality.diversion_scan(docs, contact=_MAIL, also={"title": "title"}, footer="foot")


_BEATS = r"""n as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(array_to_string(list(line order by line_no), chr(10)), '[*_`>#\[\]()~|\-]+', '', 'g'), '[.!?]+'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda n: n >= 4) as n from q group by 1),
 beat as (select doc_id, 'rhythm' as dimension, 10 * (0.62 - greatest(list_stddev_pop(n) / list_avg(n), 0.30)) / 0.32 as points from n where len(n) >= 8 and list_stddev_pop(n) / list_avg(n) < 0.62)"""
_ALL_POINTS = f"""q as (select doc_id, {_BLANK} as line, line_no from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line_no from documents)),
 h as (select doc_id, length({_CHARS}) as chars, {_HITS} from q),
 g as (select doc_id, sum(chars) as chars, sum(shout) as shout, sum(licence) as licence, sum(filler) as filler from h group by 1),
 u as (select doc_id, chars, 'shout' as dimension, 12.0 as w, 2.5 as s, shout as hits from g
 union all select doc_id, chars, 'licence', 20.0, 1.0, licence from g
 union all select doc_id, chars, 'filler', 8.0, 30.0, filler from g),
 each as (select doc_id, dimension, cast(case when hits = 1 then least(w * least(1, hits * (1000.0 / greatest(chars, 800)) / s), w * 0.3) else w * least(1, hits * (1000.0 / greatest(chars, 800)) / s) end as double) as points from u where hits > 0), {_BEATS},
 points as (select * from each
 union all select * from beat),
 flavor as (select d.doc_id, cast(least(100, round_even(coalesce(sum(points), 0), 0)) as int) as flavor, coalesce(array_to_string(list(dimension order by round(points, 9) desc, dimension)[1:3], ','), '') as top from documents d left join points using (doc_id) group by 1)"""


@query(
    "flavor_findings",
    f"""with {_PLAIN.replace("as line from documents", "as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents").replace("as line from (", "as line, line_no from (")},
 f as (select doc_id, 'shout' as dimension, line_no, 1 as p, unnest(regexp_extract_all(line, '!!')) as found from p
 union all select doc_id, 'licence', line_no, 1, unnest(regexp_extract_all(line, '[Ll]icensed under')) from p
 
 union all select doc_id, 'licence', line_no, 2, unnest(regexp_extract_all(line, 'All rights reserved')) from p
 union all select doc_id, 'filler', line_no, 1, trim(unnest(regexp_extract_all(line, ' the '))) from p
 union all select doc_id, 'filler', line_no, 2, trim(unnest(regexp_extract_all(line, ' und '))) from p),
 o as (select *, row_number() over (partition by doc_id, dimension order by line_no, p) as ord from f)
 select doc_id, dimension, line_no, ord, found from o where ord <= 12""",
)
def flavor_findings(spark, d):
    found = quality.flavor_findings(table(spark, d, "documents").select("doc_id", "text"), [*DIMENSIONS[:2], quality.Dimension("filler", 8.0, 30.0, (" the ", " und "))])
    return found.select("doc_id", "dimension", "line_no", "ord", "found")


@query(
    "grade_drafts",
    f"""with {_ALL_POINTS}, s as ({{score}}),
 w as (select doc_id, cast(sum(len(list_distinct(list_transform(regexp_extract_all(line, 'https?://[^\\s"''<>()\\[\\]，、。；（）【】]+'), lambda u: regexp_replace(u, '[.,:;!?]+$', ''))))) as bigint) as n from q0 group by 1)
 select doc_id, score, flavor, case when flavor < 20 then 'faint' when flavor < 45 then 'some' when flavor < 70 then 'strong' else 'heavy' end as level, top, coalesce(n, 0) as diversions, flavor >= 45 as notice from s join flavor using (doc_id) left join w using (doc_id)""".replace("{score}", "select * from scored").replace("with q as", "with scored as (__SCORE__), q0 as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents), q as").replace("__SCORE__", _SCORE_SQL),
)
def grade_drafts(spark, d):
    """Score, style and diversions of every document. (No text has a film's address, a code picture or a contact of that form.)"""
    rows = _score(spark, d).select("doc_id", "score", quality.flavor(F.coalesce("text", F.lit("")), DIMENSIONS, ".!?").alias("f"), quality.n_diversions(F.col("text")).alias("diversions"))
    return rows.select("doc_id", "score", F.col("f.score").alias("flavor"), "f.level", "f.top", "diversions", (F.col("f.score") >= 45).alias("notice"))


@query("prune_images", "select doc_id, md5('![](https://h.example/' || doc_id || '.jpg) text' || chr(10) || chr(10) || coalesce(text, '') || ' ![](made.png)' || case when doc_id % 2 = 0 then '' else '![](https://h.example/other.png)' end) as body_md5 from documents where not contains(coalesce(text, ''), chr(10) || chr(10) || chr(10)) and not contains(coalesce(text, ''), '![')")
def prune_images(spark, d):
    """Texts with a picture that repeats in another spelling, furniture, a made picture and one that half of the lists lack. (No text has pictures or
    three line ends in a row.)"""
    own = F.concat(F.lit("https://h.example/"), "doc_id", F.lit(".jpg"))
    body = F.concat(F.lit("![]("), own, F.lit(") text\n\n"), F.coalesce("text", F.lit("")), F.lit(" ![](made.png)![x]("), own, F.lit(")![](https://h.example/logo.svg)![](https://h.example/other.png)"))
    listed = F.when(F.col("doc_id") % 2 == 0, F.array(own)).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.prune_images(body, listed)).alias("body_md5"))


_OPS = "case event_type when 'purchase' then 'finish' when 'error' then 'fail' when 'refund' then 'cancel' when 'signup' then 'cancel' else 'log' end"


@query(
    "op_state",
    f"""with e as (select user_id as op_id, event_id as seq, {_OPS} as event, case when event_id % 3 <> 0 then event_type || event_id end as line, case when event_id % 2 = 0 then props end as stats from events),
 a as (select op_id, arg_max(event, seq) filter (event <> 'log') as last, count(line) as lines, arg_max(line, seq) filter (line is not null) as last_line, arg_max(stats, seq) filter (stats is not null) as stats from e group by 1),
 f as (select op_id, max(seq) as seq from e where event in ('fail', 'cancel') group by 1)
 select a.op_id, case last when 'finish' then 'done' when 'fail' then 'error' when 'cancel' then 'cancelled' else 'running' end as status, lines, last_line, case e.event when 'fail' then e.line when 'cancel' then 'cancelled' end as error, a.stats
 from a left join f using (op_id) left join e on e.op_id = f.op_id and e.seq = f.seq""",
)
def op_state(spark, d):
    """Users as operations: what comes after an end leaves the status as it is."""
    e = table(spark, d, "events")
    line, stats = F.when(F.col("event_id") % 3 != 0, F.concat("event_type", "event_id")), F.when(F.col("event_id") % 2 == 0, F.col("props"))
    return batch_twins.op_state(e.select(F.col("user_id").alias("op_id"), F.col("event_id").alias("seq"), F.expr(_OPS).alias("event"), line.alias("line"), stats.alias("stats")))


query("ingest", batch_twins.INGEST_SQL)(lambda spark, d: batch_twins.ingest_all(spark, d))
