"""Queries over pages: URL operators, HTML to tables, crawling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.functions import html as H
from gleanings.functions import urls as U
from gleanings.operators import aggs, crawl
from gleanings.plans.registry import query
from gleanings.session import table
from gleanings.sources import io

_S = r"[A-Za-z][A-Za-z0-9+.\-]*"


def _parts(of: str = "url") -> str:
    """DuckDB columns sch, net, pth and qry of a URL."""
    return (
        rf"regexp_extract({of}, '^({_S}):', 1) as sch, regexp_extract({of}, '^(?:{_S}:)?//([^/?#]*)', 1) as net, "
        rf"regexp_extract({of}, '^(?:{_S}:)?(?://[^/?#]*)?([^?#]*)', 1) as pth, regexp_extract({of}, '^[^?#]*\?([^#]*)', 1) as qry"
    )


_P = f"parts as (select page_id, url, {_parts()} from pages)"
_PATH = "case when regexp_replace(pth, '/+$', '') = '' then '/' else regexp_replace(pth, '/+$', '') end"


def _names(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _query_sql(drop, keep_blank: bool) -> str:
    blank = "" if keep_blank else " and substr(x, length(split_part(x, '=', 1)) + 2) <> ''"
    form = "case when contains(x, '=') then x else x || '=' end"
    return f"array_to_string(list_transform(list_filter(string_split(qry, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({_names(drop)}){blank}), lambda x: {form}), '&')"


_NORM = f"case when net <> '' then lower(sch) || '://' || net else '' end || {_PATH} || case when {_query_sql(U.TRACKING, False)} <> '' then '?' || {_query_sql(U.TRACKING, False)} else '' end"


def _of_url(function, name):
    return lambda spark, d: table(spark, d, "pages").select("page_id", function(F.col("url")).alias(name))


query("normalize_url", f"with {_P} select page_id, {_NORM} as norm_url from parts")(_of_url(U.normalize_url, "norm_url"))
query("fingerprint", f"with {_P} select page_id, sha256({_NORM}) as fingerprint from parts")(_of_url(U.fingerprint, "fingerprint"))
_SEARCH = f"case when lower(sch) in ('http', 'https') and net <> '' then lower(sch) || '://' || lower(net) || {_PATH} || case when {_query_sql(U.SEARCH_TRACKING, True)} <> '' then '?' || {_query_sql(U.SEARCH_TRACKING, True)} else '' end else '' end"
query("normalize_search_url", f"with {_P} select page_id, {_SEARCH} as norm_url from parts")(_of_url(U.normalize_search_url, "norm_url"))
_KEY = f"regexp_replace(lower(net), '^www\\.', '') || {_PATH} || case when qry <> '' then '?' || qry else '' end"
query("url_key", f"with {_P} select page_id, {_KEY} as url_key from parts")(_of_url(U.url_key, "url_key"))

_TIER = rf"""case when len(segs) = 0 then 'home'
 when contains(segs[-1], '.') and split_part(segs[-1], '.', -1) in ({_names(U.ASSET_ENDINGS)}) then 'asset'
 when list_has_any(segs, [{_names(U.HARD_SEGMENTS)}]) or list_has_any(list_transform(segs, lambda s: regexp_replace(s, '\.(html?|php|aspx?|jsp)$', '')), [{_names(U.HARD_SEGMENTS)}]) then 'hard'
 when len(segs) <= 2 and list_has_any(segs, [{_names(U.SOFT_SEGMENTS)}]) then 'soft'
 when len(segs) <= 2 and segs[-1] in ({_names(U.INDEX_SEGMENTS)}) then 'index'
 when starts_with(segs[-1], 'index.') then 'index' else 'article' end"""
_SEGS = "list_filter(string_split(lower(pth), '/'), lambda s: s <> '') as segs"
query("classify_url", f"with {_P}, s as (select *, {_SEGS} from parts) select page_id, {_TIER} as tier from s")(_of_url(U.classify_url, "tier"))
query("looks_like_feed_url", f"with {_P} select page_id, case when ends_with(regexp_replace(lower(pth) || '?' || lower(qry), '/+$', ''), '.xml') or regexp_matches(lower(pth) || '?' || lower(qry), 'rss|feed|atom') then 'rss' else 'scrape' end as kind from parts")(_of_url(U.looks_like_feed_url, "kind"))
_FURN = (
    "(" + " or ".join([f"starts_with(lower(net), '{x}') or contains('.' || lower(net), '.{x}')" for x in U.FURNITURE_HOSTS] + [f"contains(lower(pth), '{x}')" for x in U.FURNITURE_WORDS]) + " or regexp_matches(lower(pth), '(^|[^0-9])1x1([^0-9]|$)'))"
)
_VIDEO = "(" + " or ".join([f"contains(lower(url), '{x}')" for x in U.VIDEO_HOSTS] + [f"ends_with(split_part(split_part(lower(url), '?', 1), '#', 1), '{x}')" for x in U.VIDEO_ENDINGS]) + ")"
_INPLAT = "(" + " or ".join(f"lower(net) = '{d}' or ends_with(lower(net), '.{d}')" for d in U.IN_PLATFORM) + ")"
_ENGINE = r"regexp_matches(lower(net) || pth, '(^|\.)(bing\.com|google\.[a-z.]+|baidu\.com|duckduckgo\.com)/(search|s|html)?$')"
_any = lambda text, values, test="contains": " or ".join(f"{test}({text}, '{v}')" for v in values)
_PIC = "replace(lower(url), 'apple.touch', 'apple-touch')"
_PARTS = f"string_split({_PIC}, '.')"
_STEM = lambda k: f"regexp_extract({_PARTS}[{k}], '[\\w-]*$')"
_CHROME = (
    f"({_any(_PIC, [f'{n}.{e}' for n in U.LOADERS for e in U.LOADER_ENDINGS])} or {_any(_PIC, U.THUMBNAILS)}"
    f" or len(list_filter(range(1, len({_PARTS})), lambda k: ({_any(_STEM('k'), U.ICONS)}) and ({_any(f'{_PARTS}[k + 1]', U.ICON_ENDINGS, 'starts_with')}))) > 0"
    f" or ({_PARTS}[-1] = 'svg' and ({_any(_STEM('-2'), U.DRAWN)})))"
)
query("url_class", f"with {_P} select page_id, case when {_FURN} then 'furniture' when {_CHROME} then 'chrome' when {_INPLAT} then 'in_platform' when {_VIDEO} then 'video' when {_ENGINE} then 'search' else 'content' end as class from parts")(_of_url(U.url_class, "class"))
_HOST = r"lower(regexp_replace(regexp_replace(net, '^.*@', ''), ':\d*$', ''))"
query("public_url", f"with {_P} select page_id, coalesce(lower(sch) in ('http', 'https') and {_HOST} <> '' and {_HOST} <> 'localhost' and not regexp_matches({_HOST}, '\\.(local|internal|localhost)$') and not regexp_matches({_HOST}, '^(0|10|127|169\\.254|192\\.168|172\\.(1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5])\\.'), false) as public from parts")(
    _of_url(U.public_url, "public")
)
query("media_url_triage", f"with {_P} select page_id, case when starts_with(lower(url), 'data:') then 'data uri' when not regexp_matches(lower(url), '^(https?|ftp)://') and not starts_with(url, '//') then 'non-standard scheme' when length({_HOST}) <= 2 and regexp_matches(lower(pth), '^/[a-z]\\.(png|jpg|jpeg|gif|webp|mp4)$') then 'test data' end as reason from parts")(
    _of_url(U.media_url_triage, "reason")
)


@query("media_url", r"select page_id, case when page_id % 3 = 1 then 'https:' || regexp_replace(url, '^https?:', '') else url end || case when page_id % 3 = 0 and page_id % 2 = 0 then '/a%20b%C3%A9=1' else '' end as media_url from pages")
def media_url(spark, d):
    """Attribute values as crawled pages have them, made of the page addresses, undone again."""
    p = table(spark, d, "pages")
    tail = F.when(F.col("page_id") % 2 == 0, F.lit("/a b\u00e9\\u003d1")).otherwise(F.lit(" 2x, other.png 1x"))
    dressed = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.replace("url", F.lit("&"), F.lit("&amp;")), tail))
        .when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?:", ""))
        .otherwise(F.concat(F.lit("https://proxy.example.org/img?url="), F.url_encode("url")))
    )
    return p.select("page_id", U.media_url(dressed).alias("media_url"))


query("safe_dir_name", r"""with n as (select doc_id, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .') as name from documents),
 m as (select doc_id, name, upper(split_part(name, '.', 1)) as stem from n),
 c as (select doc_id, name, trim(substr(case when stem in ('CON', 'PRN', 'AUX', 'NUL') or regexp_matches(stem, '^(COM|LPT)[1-9]$') then '_' || name else name end, 1, 80), ' .') as cut from m)
 select doc_id, case when name = '' or cut = '' then 'uncategorized' else cut end as dir_name from c""")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", U.safe_dir_name(F.substring_index("text", "\n", 1)).alias("dir_name"))
)
query("slugify", r"""with k as (select doc_id, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9\s\-]', '', 'g'), '[\s_\-]+', '-', 'g'), '-') as s from documents)
 select doc_id, case when s = '' then 'untitled' else s end as slug from k""")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", U.slugify(F.substring_index("text", "\n", 1)).alias("slug"))
)

_LINKS = rf"""
hrefs as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s">]+)')) as tag, generate_subscripts(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s">]+)'), 1) - 1 as pos from pages),
each as (select page_id, url, pos, trim(trim(regexp_extract(tag, '(?i)\bhref\s*=\s*(.*)$', 1, 's'), '"''')) as href from hrefs),
wanted as (select e.*, {_parts()} from each e where href <> '' and not regexp_matches(href, '(?i)^(#|mailto:|javascript:|tel:|data:)')),
resolved as (select page_id, url, pos, regexp_replace(case when regexp_matches(href, '^{_S}:') then href when starts_with(href, '//') then sch || ':' || href when starts_with(href, '/') then sch || '://' || net || href
  when starts_with(href, '?') then sch || '://' || net || pth || href else sch || '://' || net || case when regexp_replace(pth, '[^/]*$', '') = '' then '/' else regexp_replace(pth, '[^/]*$', '') end || href end, '/+$', '') as link from wanted),
links as (select page_id, link, min(pos) as pos, min(url) as url from resolved group by page_id, link)
"""
query("extract_links", f"with {_LINKS} select page_id, link, cast(pos as bigint) as pos from links")(lambda spark, d: H.links(table(spark, d, "pages")))


def _linked(spark, d):
    """Pages with links that the plain ones lack: to further pages, to other hosts, to what is no article and to dot paths."""
    more = F.concat(F.lit('<a href="/page/'), F.col("page_id") % 9, F.lit('">more</a><a href="?page='), "page_id", F.lit('">next</a><a href="https://else.example/p/1">x</a><a href=/tag/one>t</a><a href="/files/a.pdf">f</a><a href=/privacy/x>p</a>'))
    return table(spark, d, "pages").withColumn("html", F.concat("html", more))


_MORE = "html || '<a href=\"/page/' || (page_id % 9) || '\">more</a><a href=\"?page=' || page_id || '\">next</a><a href=\"https://else.example/p/1\">x</a><a href=/tag/one>t</a><a href=\"/files/a.pdf\">f</a><a href=/privacy/x>p</a>'"
_LINKED = _LINKS.replace("from pages)", f"from (select page_id, url, {_MORE} as html from pages))")


@query("pagination_links", f"""with {_LINKED}, s as (select *, regexp_extract(url, '^(?:{_S}:)?//([^/?#]*)', 1) as a, regexp_extract(link, '^(?:{_S}:)?//([^/?#]*)', 1) as b from links)
 select page_id, link from s where a = b and regexp_matches(link, '(?i)[?&]page=\\d+|/page/\\d+|/p/\\d+')""")
def pagination_links(spark, d):
    pages = _linked(spark, d)
    found = H.links(pages).join(pages.select("page_id", "url"), "page_id")
    return found.filter((U.netloc(F.col("url")) == U.netloc(F.col("link"))) & H.is_pagination(F.col("link"))).select("page_id", "link")


@query("accept_links", f"""with {_LINKED}, s as (select page_id, link, regexp_extract(url, '^(?:{_S}:)?//([^/?#]*)', 1) as base, {_parts('link')} from links),
 g as (select *, {_SEGS} from s)
 select page_id, link from g where net = base and contains(link, '/') and not contains(link, 'tag') and {_TIER} = 'article'""")
def accept_links(spark, d):
    pages = _linked(spark, d)
    rules = pages.select("page_id", U.netloc(F.col("url")).alias("base_host"), F.lit("/").alias("include_pattern"), F.lit("tag").alias("exclude_pattern"))
    return crawl.accept_links(H.links(pages).join(rules, "page_id")).select("page_id", "link")


_STRIP = r"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')"
_TITLE = f"case when {_STRIP.format(x=chr(39).join(['regexp_extract(html, ', '(?is)<h1\\b[^>]*>(.*?)</h1>', ', 1)']))} <> '' then {_STRIP.format(x=chr(39).join(['regexp_extract(html, ', '(?is)<h1\\b[^>]*>(.*?)</h1>', ', 1)']))} else {_STRIP.format(x=chr(39).join(['regexp_extract(html, ', '(?is)<title\\b[^>]*>(.*?)</title>', ', 1)']))} end"
_PARAS = f"array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {_STRIP.format(x='x')}), lambda x: x <> ''), chr(10) || chr(10))"
query("page_title", f"select page_id, {_TITLE} as title from pages")(lambda spark, d: table(spark, d, "pages").select("page_id", H.page_title(F.col("html")).alias("title")))
query("paragraph_text", f"select page_id, {_PARAS} as body from pages")(lambda spark, d: table(spark, d, "pages").select("page_id", H.paragraph_text(F.col("html")).alias("body")))


def _article_sql(title: str, body: str) -> str:
    lines = rf"len(list_filter(string_split(b, chr(10)), lambda s: not regexp_matches(s, '^\s*$') and not regexp_matches(s, '^\s*http') and not starts_with(s, '![') and not regexp_matches(s, '^\s*\[\[(?:IMG|VIDEO):'))) >= 3"
    linked = r"coalesce(list_sum(list_transform(regexp_extract_all(b, '(\[[^\]]+\]\([^)]+\))', 1), lambda x: length(x))), 0) * 5 <= length(regexp_replace(b, '\s', '', 'g')) * 2"
    listing = " or ".join(f"starts_with(regexp_replace(t, '[\\s\u00a0]+', ' ', 'g'), '{x}')" for x in H.LISTING_STARTS)
    return f"length(b) >= 300 and {lines} and {linked} and not (t in ('404', 'page not found', 'not found') or (contains(t, '404') and contains(t, 'not found'))) and not ({listing})"


query("is_article", rf"""with a as (select doc_id, lower(trim(split_part(coalesce(text, ''), chr(10), 1))) as t, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as b from documents)
 select doc_id, {_article_sql('t', 'b')} as is_article from a""")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", H.is_article(F.substring_index("text", "\n", 1), F.col("text")).alias("is_article"))
)
query("extract_articles", rf"""with e as (select page_id, url, case when {_TITLE} = '' then url else {_TITLE} end as title, {_PARAS} as body from pages),
 a as (select *, lower(trim(title)) as t, regexp_replace(body, '^\s+|\s+$', '', 'g') as b from e)
 select page_id, title, body as content_md from a where {_article_sql('t', 'b')}""")(
    lambda spark, d: io.extract_articles(table(spark, d, "pages")).select("page_id", "title", "content_md")
)
query("strip_boilerplate", r"""with l as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda s: not regexp_matches(s, '^\s*$') and not regexp_matches(s, '^\s*http') and not starts_with(s, '![') and not regexp_matches(s, '^\s*\[\[(?:IMG|VIDEO):')) as ls from documents)
 select doc_id, md5(case when len(ls) > 0 and len(list_filter(ls, lambda s: not regexp_matches(s, '(?i)licen[cs]ed? |all rights reserved|!!'))) = 0 then '' else text end) as body_md5 from l""")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.md5(H.strip_boilerplate(F.col("text"), "(?i)licen[cs]ed? |all rights reserved|!!")).alias("body_md5"))
)
@query("is_feed_document", "select page_id, page_id % 4 = 0 or (page_id % 4 <> 1 and regexp_matches(lower(substr(ltrim(html), 1, 1500)), '<rss|<feed|<rdf:rdf|<channel')) as is_feed from pages")
def is_feed_document(spark, d):
    """Pages, of which a quarter is wrapped as a feed, and a quarter names a feed only behind its first 1,500 characters."""
    html = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(' \n<?xml version="1.0"?><RSS version="2.0">'), "html")).when(F.col("page_id") % 4 == 1, F.concat(F.repeat(F.lit("x"), 1500), F.lit("<rss>"), "html")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", H.is_feed_document(html).alias("is_feed"))


@query("feed_of_site", f"""with {_P}, f as (select net as site, page_id % 5 as path_ord, min(url) as url from parts where page_id % 3 = 0 group by 1, 2)
 select site, arg_min(url, path_ord) as url from f group by 1""")
def feed_of_site(spark, d):
    """The first well-known path of each site whose document is a feed: every third page is one, at one of five paths."""
    p = table(spark, d, "pages")
    docs = p.select(U.netloc(F.col("url")).alias("site"), (F.col("page_id") % 5).alias("path_ord"), "url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<feed>"), "html")).otherwise(F.col("html")).alias("text"))
    return crawl.feed_of_site(docs)


def _dressed(spark, d):
    """Crawled pages with the media, dates and feeds that the plain ones lack, all made of their own addresses."""
    p = table(spark, d, "pages")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 3600)
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("page_id") % 6
    dated = (
        F.when(kind == 0, F.concat(F.lit('<meta property="article:published_time" content="'), stamp, F.lit('">')))
        .when(kind == 1, F.concat(F.lit('<time datetime="'), stamp, F.lit('">x</time>')))
        .when(kind == 2, F.concat(F.lit("<meta content='"), stamp, F.lit("' itemprop=datePublished>")))
        .when(kind == 3, F.concat(F.lit('<script>f("{\\"dateModified\\":\\"2001-01-01\\",\\"publishedAt\\":\\"'), stamp, F.lit('\\"}")</script>')))
        .when(kind == 4, F.concat(F.lit('<meta name="DC.Date" content="'), stamp, F.lit('"><meta name="date" content="no date">')))
        .otherwise(F.concat(F.lit('<script>{"createdAt": "2001-01-01"}</script><p>Posted '), F.date_format(at, "MMM d, yyyy"), F.lit("</p>")))
    )
    head = F.concat(
        dated,
        F.when(F.col("page_id") % 4 == 0, F.lit('<link rel="alternate" type="application/rss+xml" href="/feed.xml">')).when(F.col("page_id") % 4 == 1, F.lit("<link type=application/atom+xml href=/atom.xml>")).otherwise(""),
        F.lit('<script type="application/ld+json">{"@type": "NewsArticle", "image": {"url": "/lead-'), F.col("page_id"), F.lit('.jpg"}}</script>'),
    )
    media = F.concat(F.lit('<img data-src="/pics/'), F.col("page_id"), F.lit('.jpg"><img src="data:image/png;base64,x"><img src=/assets/logo.svg><source srcset="../up/a.avif 2x, b.png"><video src=/films/'), F.col("page_id"), F.lit('.mp4></video><iframe src="https://www.youtube.com/embed/'), F.col("page_id"), F.lit('"></iframe>'))
    return p.withColumn("html", F.concat(head, "html", media))


_ROOT = "sch || '://' || net"
#: "../up/a.avif" against the page: its folder's parent; no path of the pages has dots itself.
_UP = f"{_ROOT} || regexp_replace(regexp_replace(pth, '[^/]*$', ''), '[^/]+/$', '') || case when regexp_replace(pth, '[^/]*$', '') = '' then '/' else '' end || 'up/a.avif'"


@query("extract_images", f"""with {_P}, i as (select page_id, [{_ROOT} || '/pics/' || page_id || '.jpg', {_ROOT} || '/assets/logo.svg', {_UP}, {_ROOT} || '/lead-' || page_id || '.jpg'] as x from parts)
 select page_id, unnest(range(4)) as pos, unnest(x) as image from i""")
def extract_images(spark, d):
    return _dressed(spark, d).select("page_id", F.posexplode(H.images(F.col("html"), F.col("url"))).alias("pos", "image"))


@query("extract_videos", f"""with {_P}, i as (select page_id, ['https://www.youtube.com/embed/' || page_id, {_ROOT} || '/films/' || page_id || '.mp4'] as x from parts)
 select page_id, unnest(range(2)) as pos, unnest(x) as video from i""")
def extract_videos(spark, d):
    return _dressed(spark, d).select("page_id", F.posexplode(H.videos(F.col("html"), F.col("url"))).alias("pos", "video"))


@query("published_at", "select page_id, case when page_id % 6 = 5 then cast(cast(to_timestamp(1700000000 + page_id * 3600) as date) as timestamp) else to_timestamp(1700000000 + page_id * 3600)::timestamp end as published_at from pages")
def published_at(spark, d):
    """A date in a tag of each kind, in escaped JSON, and written out; the last with a less trusted one in front."""
    return _dressed(spark, d).select("page_id", H.published_at(F.col("html"), F.lit("2100-01-01").cast("timestamp")).alias("published_at"))


@query("jsonld_image", f"with {_P} select page_id, {_ROOT} || '/lead-' || page_id || '.jpg' as image from parts")
def jsonld_image(spark, d):
    return _dressed(spark, d).select("page_id", H.jsonld_image(F.col("html"), F.col("url")).alias("image"))


@query("feed_links", f"with {_P} select page_id, {_ROOT} || '/feed.xml' as feed from parts where page_id % 4 = 0")
def feed_links(spark, d):
    return _dressed(spark, d).select("page_id", F.explode(H.feed_links(F.col("html"), F.col("url"))).alias("feed"))


@query("feed_source", f"with {_P} select page_id, case page_id % 4 when 0 then {_ROOT} || '/feed.xml' when 1 then {_ROOT} || '/atom.xml' else url end as source, case when page_id % 4 < 2 then 'rss' else 'scrape' end as type from parts")
def feed_source(spark, d):
    """A page's feed whatever its relation, else the page itself."""
    found = _dressed(spark, d).select("page_id", H.feed_source(F.col("html"), F.col("url")).alias("s"))
    return found.select("page_id", F.col("s.url").alias("source"), "s.type")


def _cited(spark, d):
    """Bodies out of the pages' own paragraphs with media referred to between them."""
    p = table(spark, d, "pages")
    body = H.paragraph_text(F.col("html"))
    front = F.concat(F.lit("![a](https://h.example/"), "page_id", F.lit('.jpg) <img src="/two.png"> '))
    back = F.concat(F.lit(" ![b](https://h.example/"), "page_id", F.lit('.jpg) <video src="https://h.example/'), "page_id", F.lit('.mp4"></video> ▶ [film](https://h.example/f.webm) ▶ [page](https://h.example/watch)'))
    return p.select("page_id", "url", F.concat(front, body, back).alias("body"))


@query("body_media", "select page_id, m from pages, unnest(['https://h.example/' || page_id || '.jpg', '/two.png', 'https://h.example/' || page_id || '.mp4', 'https://h.example/f.webm']) t(m)")
def body_media(spark, d):
    """(No paragraph of the pages refers to media itself.)"""
    return _cited(spark, d).select("page_id", F.explode(H.body_media(F.col("body"))).alias("m"))


@query("has_video", f"select page_id, page_id % 3 <> 2 or regexp_matches({_PARAS}, '(?i)\\.(?:mp4|webm|mov|m4v|ogv|m3u8)\\b|<video\\b|youtube\\.com/|youtu\\.be/') as has_video from pages")
def has_video(spark, d):
    """Paragraphs with a token, beside a listed video, or as they are."""
    body = H.paragraph_text(F.col("html"))
    marked = F.when(F.col("page_id") % 3 == 0, F.concat(body, F.lit(" [[VID:1]]"))).otherwise(body)
    listed = F.when(F.col("page_id") % 3 == 1, F.array("url")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "pages").select("page_id", H.has_video(marked, listed).alias("has_video"))


@query(
    "clean_image_list",
    f"""with {_P}, t as (select page_id, {_TITLE} as title from pages),
 u as (select page_id, {_ROOT} || '/pics/' || page_id || '.jpg' || chr(10) || {_UP} || chr(10) || {_ROOT} || '/lead-' || page_id || '.jpg' as images from parts)
 select page_id, images, '[[IMG:1]]' || chr(10) || chr(10) || '[[IMG:2]]' || chr(10) || chr(10) || chr(10) || chr(10) || 'text' || chr(10) || chr(10) || '[[IMG:0]]' || chr(10) || chr(10) || title as body from t join u using (page_id)""",
)
def clean_image_list(spark, d):
    """The second picture is furniture: its token goes, and those of the third and fourth, which the body lacks, come in front."""
    rows = _dressed(spark, d).select("page_id", H.images(F.col("html"), F.col("url")).alias("images"), F.concat(F.lit("[[IMG:1]]\n\ntext\n\n[[IMG:0]]\n\n"), H.page_title(F.col("html"))).alias("body"))
    return crawl.clean_image_list(rows)


_MAP_PAGES = 40


@query("sitemap_urls", rf"""with {_P}, locs as (select net, url, min(page_id) as page_id from parts group by net, url),
 r as (select net as site, url as loc, row_number() over (partition by net order by page_id, url) - 1 as rn, sch from (select l.*, p.sch from locs l join parts p using (page_id)))
 select site, loc from r where rn < least(300, 11 * {_MAP_PAGES}) and contains(loc, '/')""")
def sitemap_urls(spark, d):
    """Each host's robots file names an index, which names maps of some pages each; they are read with the include text and the limits."""
    p = table(spark, d, "pages").withColumn("site", U.netloc(F.col("url")))
    once = p.groupBy("site", "url").agg(F.min("page_id").alias("page_id"))
    # places by a window a host; pages of a host are many, its maps few
    placed = once.withColumn("_n", F.row_number().over(W.partitionBy("site").orderBy("page_id", "url")) - 1).withColumn("part", F.floor(F.col("_n") / _MAP_PAGES).cast("int"))
    root = F.concat(F.lit("http://"), "site")
    entry = lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = placed.groupBy("site", "part").agg(F.array_sort(F.collect_list(F.struct("_n", "url"))).alias("x")).select("site", F.concat(root, F.lit("/map-"), "part", F.lit(".xml")).alias("address"), F.concat(F.lit("<urlset>"), F.array_join(F.transform("x", lambda x: entry(x["url"])), ""), F.lit("</urlset>")).alias("text"))
    first = placed.groupBy("site").agg(F.max("part").alias("last"))
    locs = F.transform(F.sequence(F.lit(0), "last"), lambda k: F.concat(F.lit("<sitemap><loc>"), root, F.lit("/map-"), k, F.lit(".xml</loc></sitemap>")))
    index = first.select("site", F.concat(root, F.lit("/all.xml")).alias("address"), F.concat(F.lit("<sitemapindex>"), F.array_join(locs, ""), F.lit("</sitemapindex>")).alias("text"))
    robots = first.select("site", F.concat(root, F.lit("/robots.txt")).alias("address"), F.concat(F.lit("User-agent: *\nSitemap: "), root, F.lit("/all.xml\n")).alias("text"))
    return crawl.sitemap_urls(maps.unionByName(index).unionByName(robots), include="/")


_HOPS = rf"""
with recursive {_LINKS.strip()},
nodes as (select distinct regexp_extract(url, '^(?:{_S}:)?//([^/?#]*)', 1) as site, regexp_replace(split_part(url, '#', 1), '/+$', '') as u, page_id from pages),
edges as (select distinct n.u as src, n.site, split_part(l.link, '#', 1) as dst from links l join nodes n on n.page_id = l.page_id where regexp_extract(l.link, '^(?:{_S}:)?//([^/?#]*)', 1) = n.site),
seeds as (select site, min(u) as u from nodes group by site),
walk(site, u, level) as (select site, u, 0 from seeds union select e.site, e.dst, w.level + 1 from walk w join edges e on e.src = w.u and e.site = w.site where w.level < 2)
select site, u as url, cast(min(level) as int) as level from walk group by site, u
"""


@query("crawl_frontier", _HOPS)
def crawl_frontier(spark, d):
    """Pages of each host within two links of its first page."""
    pages = table(spark, d, "pages").withColumn("site", U.netloc(F.col("url")))
    clean = F.regexp_replace(F.substring_index("url", "#", 1), "/+$", "")
    nodes = pages.select("page_id", "site", clean.alias("u"))
    edges = H.links(pages.select("page_id", "url", "html")).join(nodes, "page_id").filter(U.netloc(F.col("link")) == F.col("site")).select("site", F.col("u").alias("src"), F.substring_index("link", "#", 1).alias("dst")).distinct()
    return crawl.frontier(edges, nodes.groupBy("site").agg(F.min("u").alias("url")), levels=2)


_SITE = rf"regexp_extract(url, '^(?:{_S}:)?//([^/?#]*)', 1)"


@query(
    "crawl_site",
    rf"""with recursive {_LINKS.strip()},
 nodes as (select {_SITE} as site, regexp_replace(split_part(url, '#', 1), '/+$', '') as u, page_id from pages),
 firsts as (select site, min(u) as seed, min(page_id) as p from nodes group by site),
 edges as (select distinct n.u as src, n.site, split_part(l.link, '#', 1) as dst from links l join nodes n on n.page_id = l.page_id join firsts f on f.site = n.site where f.p % 2 = 0 and regexp_extract(l.link, '^(?:{_S}:)?//([^/?#]*)', 1) = n.site),
 walk(site, u) as (select site, seed from firsts union select e.site, e.dst from walk w join edges e on e.src = w.u and e.site = w.site),
 known as (select distinct w.site, regexp_replace(w.u, '/+$', '') as link, seed from walk w join firsts using (site)),
 k as (select *, {_parts('link')} from known),
 g as (select *, {_SEGS} from k),
 way0 as (select site, link as url from g where net = site and link <> seed and {_TIER} = 'article'),
 more1 as (select site, 'https://' || site || '/page/2' as url from firsts where p % 3 = 0),
 way1 as (select * from more1 where site not in (select site from way0)),
 way2 as (select site, 'https://' || site || '/feed/one' as url from firsts where site not in (select site from way0) and site not in (select site from way1))
 select site, url, 0 as way from way0
 union all select site, url, 1 from way1
 union all select site, url, 2 from way2""",
)
def crawl_site(spark, d):
    """Article addresses of every host from its first page on; hosts whose links are left out take further pages, or else their feed."""
    pages = table(spark, d, "pages").withColumn("site", U.netloc(F.col("url")))
    nodes = pages.select("page_id", "site", F.regexp_replace(F.substring_index("url", "#", 1), "/+$", "").alias("u"))
    firsts = nodes.groupBy("site").agg(F.min("u").alias("url"), F.min("page_id").alias("p"))
    edges = H.links(pages.select("page_id", "url", "html")).join(nodes, "page_id").join(firsts.filter("p % 2 = 0").select("site"), "site").filter(U.netloc(F.col("link")) == F.col("site")).select("site", F.col("u").alias("src"), F.substring_index("link", "#", 1).alias("dst")).distinct()
    seeds = firsts.select("site", "url", F.lit(None).cast("string").alias("include_pattern"), F.lit(None).cast("string").alias("exclude_pattern"))
    further = firsts.filter("p % 3 = 0").select("site", F.concat(F.lit("https://"), "site", F.lit("/page/2")).alias("url"))
    feeds = firsts.select("site", F.concat(F.lit("https://"), "site", F.lit("/feed/one")).alias("url"))
    return crawl.crawl_site(edges, seeds, [further, feeds], max_pages=1000)


_REASON = (
    "case when regexp_matches(m, '403|forbidden') then '403 forbidden' when regexp_matches(m, '404|not found') then '404 not found' when regexp_matches(m, '429|too many requests') then '429 rate limited' when regexp_matches(m, 'getaddrinfo|nameresolution|failed to resolve|name or service not known') then 'dns' "
    "when regexp_matches(m, 'redirect') then 'redirects' when regexp_matches(m, 'timed out|timeout') then 'timeout' when regexp_matches(m, 'forcibly closed|connection reset|10054|closed connection|incompleteread|connection broken|connection aborted') then 'reset' when regexp_matches(m, 'ssl|certificate') then 'tls' "
    "when regexp_matches(m, '\\b5[0-9][0-9]\\b|server error') then '5xx' else 'other' end"
)


@query("skip_reasons", f"""with f as (select event_type as source, lower(event_type || ' status ' || cast(floor(value) as bigint)) as m from events)
 select source, {_REASON} as reason, count(*) as n from f group by all""")
def skip_reasons(spark, d):
    e = table(spark, d, "events")
    return aggs.skip_reasons(e.select(F.col("event_type").alias("source"), F.concat("event_type", F.lit(" status "), F.floor("value").cast("string")).alias("message")))
