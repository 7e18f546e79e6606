"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from gleanings.plans import record_queries, stored_queries, text_queries, web_queries
from gleanings.plans.registry import ORACLES, QUERIES, flagship, query

_W = web_queries
query(
    "flagship",
    f"""with {_W._P}, n as (select page_id, {_W._NORM} as u, {_W._HOST} as source from parts), f as (select min(page_id) as page_id from n group by u),
 e as (select page_id, url, case when {_W._TITLE} = '' then url else {_W._TITLE} end as title, {_W._PARAS} as body from pages join f using (page_id)),
 a as (select *, lower(trim(title)) as t, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as b from e), k as (select page_id, url, title, source, length(body) as n_chars, length(title) as m, contains(lower(title), 'licensed') as hot from a join n using (page_id) where {_W._article_sql('t', 'b')}),
 s as (select *, cast(greatest(0, least(100, 50 + case when hot then 10 else 0 end + case when n_chars > 2000 then 10 when n_chars > 1000 then 5 when n_chars < 100 then -10 else 0 end + case when m >= 15 then 5 when m < 5 then -5 else 0 end)) as double) as score from k),
 r as (select *, row_number() over (partition by lower(source) order by score desc, n_chars desc, page_id) > 2 as late from s)
 select page_id, url, title, source, score, n_chars from r order by late, score desc, n_chars desc, page_id limit 100""",
)(flagship)

__all__ = ["ORACLES", "QUERIES", "flagship", "query", "record_queries", "stored_queries", "text_queries", "web_queries"]
