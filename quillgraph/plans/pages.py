"""Queries over pages, urls and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import UrlRules
from quillgraph.functions import expr as E
from quillgraph.operators import dedup, html, web
from quillgraph.sources import scans
from quillgraph.sources.state import folder
from quillgraph.sources.tables import table

RULES = UrlRules(
    host_suffixes=("spam-farm.example.org", "ththth.example.net"),
    host_path_prefixes=(("blog.tionsh.example.net", "/en"),),
    language_prefixes=("tc", "sc", "es"),
)
WHITELIST = ("*.example.com", "thther.example.org")
MAIN_HOST = "thther.example.org"

_SCHEME = "lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1))"
_HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_NORM = "coalesce(nullif(regexp_replace(lower({p}), '/+$', ''), ''), '/')"


def _url(u: str = "url") -> dict[str, str]:
    path = _PATH.format(u=u)
    return {"scheme": _SCHEME.format(u=u), "host": _HOST.format(u=u), "path": path, "norm": _NORM.format(p=path)}


def url_parts_normalized(spark: SparkSession, d: str) -> DataFrame:
    return web.url_parts(table(spark, d, "pages")).select("page_id", "scheme", "host", "path")


def url_whitelist(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", E.host_allowed(E.url_host(F.col("url")), WHITELIST).alias("allowed"))


def variants(pages: DataFrame) -> DataFrame:
    """(page_id, n, url): every page's url and made-up ones on its host that meet each rule."""
    root = F.concat(E.url_scheme(F.col("url")), F.lit("://"), E.url_host(F.col("url")))
    n = F.col("page_id")
    year = lambda base, mod: (F.lit(base) + n % mod).cast("string")
    made = [
        F.col("url"),
        F.concat(root, F.lit("/events/"), year(2010, 20), F.lit("/recap-"), year(2015, 15)),
        F.concat(root, F.lit("/media/a"), n.cast("string"), F.lit(".PDF")),
        F.concat(root, F.lit("/login/x")), F.concat(root, F.lit("/loginx")), F.concat(root, F.lit("/sitemap/")),
        F.concat(root, F.lit("/recent-focus/"), year(2018, 10), F.lit("0105_x")),
        F.concat(root, F.lit("/x/2020"), (n % 10).cast("string")),
        F.concat(root, F.lit("/study/pg/research-postgraduate/"), year(2019, 9), F.lit("/fees")),
        F.concat(root, F.lit("/TC/study")), F.concat(root, F.lit("/people/academic-staff/x")), F.concat(root, F.lit("/feedback")),
        F.lit("https://blog.tionsh.example.net/english"), F.lit("https://blog.tionsh.example.net/en/a"), F.concat(root, F.lit("/privacy-policy-statement")),
    ]
    return pages.select("page_id", F.posexplode(F.array(*made)).alias("n", "url"))


_ROOT = f"{_url()['scheme']} || '://' || {_url()['host']}"
_VARIANTS = f"""
variants as (
  select page_id, cast(g - 1 as integer) as n, list_extract(made, g) as url
  from (select page_id, [url,
    {_ROOT} || '/events/' || cast(2010 + page_id % 20 as varchar) || '/recap-' || cast(2015 + page_id % 15 as varchar),
    {_ROOT} || '/media/a' || cast(page_id as varchar) || '.PDF',
    {_ROOT} || '/login/x', {_ROOT} || '/loginx', {_ROOT} || '/sitemap/',
    {_ROOT} || '/recent-focus/' || cast(2018 + page_id % 10 as varchar) || '0105_x',
    {_ROOT} || '/x/2020' || cast(page_id % 10 as varchar),
    {_ROOT} || '/study/pg/research-postgraduate/' || cast(2019 + page_id % 9 as varchar) || '/fees',
    {_ROOT} || '/TC/study', {_ROOT} || '/people/academic-staff/x', {_ROOT} || '/feedback', 'https://blog.tionsh.example.net/english', 'https://blog.tionsh.example.net/en/a', {_ROOT} || '/privacy-policy-statement'] as made
    from pages) t, range(1, 16) r(g))"""


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _reason_sql() -> str:
    r = RULES
    below = " or ".join(f"(host = '{s}' or ends_with(host, '.{s}'))" for s in r.host_suffixes)
    hp = " or ".join(f"((host = '{s}' or ends_with(host, '.{s}')) and regexp_matches(path, '^{p}(/.*)?$'))" for s, p in r.host_path_prefixes)
    asset = " or ".join(f"ends_with(path, '{e}')" for e in r.extensions)
    under = " or ".join(f"(path = '{p}' or starts_with(path, '{p}/'))" for p in r.path_prefixes)
    years = ", ".join(f"nullif(regexp_extract(path, '{p}', 1), '')" for p in r.dated_patterns)
    return f"""
parts as (select page_id, n, url, {_url()['host']} as host, {_url()['norm']} as path from variants),
reasons as (select page_id, n, url, case
  when {below} then 'blocked_host'
  when {hp} then 'blocked_path'
  when regexp_extract(path, '^/([^/]*)', 1) in ({_sql_list(r.language_prefixes)}) then 'lang_mirror'
  when {asset} then 'asset'
  when path in ({_sql_list(r.exact_paths)}) then 'boilerplate'
  when {under} then 'blocked_path'
  when coalesce(cast(coalesce({years}) as integer) < {r.min_year}, false) then 'pre_min_year'
  when len(list_filter(regexp_extract_all(path, '\\d+'), lambda x: length(x) = 4 and left(x, 2) in ('19', '20') and cast(x as integer) < {r.min_year})) > 0 then 'pre_min_year'
  end as reason from parts)"""


def url_drop_reason(spark: SparkSession, d: str) -> DataFrame:
    rows = variants(table(spark, d, "pages"))
    return rows.select("page_id", "n", E.drop_reason(F.col("url"), RULES).alias("reason"))


def url_drop_histogram(spark: SparkSession, d: str) -> DataFrame:
    return web.drop_histogram(variants(table(spark, d, "pages")), RULES)


def url_discovery(spark: SparkSession, d: str) -> DataFrame:
    rows = variants(table(spark, d, "pages")).withColumn("ordinal", F.col("page_id") * 100 + F.col("n"))
    return web.discover(rows, RULES, 120)


def page_type_department(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return variants(table(spark, d, "pages")).select("page_id", "n", E.page_type(u).alias("page_type"), E.department(u).alias("department"))


def page_title_meta(spark: SparkSession, d: str) -> DataFrame:
    return web.page_meta(table(spark, d, "pages")).select("page_id", "title", "meta_description")


def error_page_reason(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 9
    made = [(1, "Access Denied"), (2, "403"), (3, "!Error page"), (4, "Error 400 bad"), (5, "Page not found"), (6, "404"), (7, "x")]
    title = F.lit("Home")
    for i, t in made:
        title = F.when(n == i, t).otherwise(title)
    body = F.when(n == 2, "Access denied by rule 403").when(n == 7, "We could not find what you were looking for").when(n == 8, "the page not found here").otherwise("plain text")
    rows = table(spark, d, "pages").select("page_id", title.alias("title"), body.alias("body"))
    return rows.select("page_id", E.error_page_reason(F.col("title"), F.lit(None).cast("string"), F.col("body")).alias("reason"))


def page_links_raw(spark: SparkSession, d: str) -> DataFrame:
    return web.raw_links(table(spark, d, "pages"))


_HREF = """
hrefs as (select url as from_url, unnest(regexp_extract_all(html, '(?i)<a[^>]*?href="([^"]*)"', 1)) as href,
  generate_subscripts(regexp_extract_all(html, '(?i)<a[^>]*?href="([^"]*)"', 1), 1) - 1 as ordinal from pages),
raw_links as (select from_url, href, cast(min(ordinal) as integer) as ordinal from hrefs
  where href <> '' and not starts_with(href, '#') and not starts_with(lower(href), 'mailto:') and not starts_with(lower(href), 'javascript:')
  group by all)"""
_BASE = "regexp_extract(from_url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
_LINKS = f"""{_HREF},
links as (select distinct from_url, regexp_replace(case
    when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*://') then href
    when starts_with(href, '//') then regexp_extract(from_url, '^([A-Za-z][A-Za-z0-9+.\\-]*:)', 1) || href
    when starts_with(href, '/') then {_BASE} || href
    when regexp_replace({_PATH.format(u='from_url')}, '[^/]*$', '') = '' then {_BASE} || '/' || href
    else {_BASE} || regexp_replace({_PATH.format(u='from_url')}, '[^/]*$', '') || href end, '[#?].*$', '') as to_url,
  'hyperlink' as link_type from raw_links)"""


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return web.links(table(spark, d, "pages"))


def link_stub_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return web.stub_pages(web.links(pages), pages)


def crawl_frontier_bfs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    seeds = pages.where("page_id < 5").select("url")
    return web.crawl_levels(seeds, web.links(pages), 3)


def crawl_seed_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select((F.col("page_id") % 7).alias("seed_no"), F.col("page_id").alias("position"), "url")
    return web.crawl_budget(rows, 60, 12)


def related_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    named = web.links(pages).withColumn("anchor_text", F.regexp_extract("to_url", "([^/]*)$", 1))
    sources = pages.where("page_id < 40").select((F.col("page_id") % 8).alias("query_id"), "url")
    return web.related_links(sources, named)


def priority_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Links to pages of programmes, some of which the crawl has."""
    n = F.col("page_id")
    to = F.concat(F.lit("https://"), E.url_host(F.col("url")), F.lit("/study/"), n.cast("string"), F.when(n % 3 == 0, "/curriculum").when(n % 3 == 1, "/faq/").otherwise("/news"))
    rows = table(spark, d, "pages").select("page_id", to.alias("to_url"))
    return web.backfill(rows, rows.where("page_id % 4 = 0").select(F.col("to_url").alias("url")))


def fetched_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a fetching service gives them: without a url of their own, with empty or missing titles and descriptions."""
    n = F.col("page_id")
    text = lambda k, tag: F.when(n % k == 0, F.lit("")).when(n % k == 1, F.concat(F.lit(tag), n.cast("string")))
    docs = table(spark, d, "pages").select(
        F.when(n % 5 > 0, F.col("url")).alias("url"), F.col("url").alias("source_url"), text(3, "t").alias("title"), text(4, "ot").alias("og_title"),
        text(6, "d").alias("description"), text(5, "od").alias("og_description"), F.lit(None).cast("string").alias("markdown"), "html",
    )
    out = scans.fetched_documents(docs, "2024-01-01")
    return out.select("url", "title", "meta_description", "department", "page_type", "crawled_at", "markdown", F.md5("html").alias("html_md5"))


def frontier_scan(spark: SparkSession, d: str) -> DataFrame:
    """The pages' urls as JSON lines, some broken, without a url or with a null one, read as a frontier."""
    n, path = F.col("page_id"), folder(spark, "frontier")
    line = F.when(n % 6 == 0, '{"url": "http://cut').when(n % 6 == 1, '{"title": "no url"}').when(n % 6 == 2, '{"url": null}').otherwise(F.to_json(F.struct("url", "page_id")))
    table(spark, d, "pages").select(line.alias("value")).write.text(path)
    return scans.frontier(spark, path)


def canonical_url_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").withColumn("grp", F.substring(E.url_host(F.col("url")), 1, 8))
    return dedup.pick_canonical(rows, "grp", MAIN_HOST)


def _key_sql(u: str) -> str:
    p = _url(u)
    return (
        f"{{'s': case when {p['scheme']} = 'https' then 0 else 1 end, 'h': case when {p['host']} = '{MAIN_HOST}' then 0 else 1 end, "
        f"'t': case when ends_with({p['path']}, '/') and {p['path']} <> '/' then 1 else 0 end, 'l': length({u}), 'u': {u}}}"
    )


def link_rewrite(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    hashed = pages.select("url", F.substring(F.md5(F.substring(E.url_host(F.col("url")), 1, 9)), 1, 16).alias("content_hash"), F.lit(1).alias("n_blocks"))
    return dedup.rewrite_links(page_graph(pages), dedup.page_actions(hashed, MAIN_HOST))


def page_graph(pages: DataFrame) -> DataFrame:
    """(from_url, to_url, link_type, anchor_text): links among known pages, by number, so that every rule is met."""
    to = pages.select(F.col("page_id").alias("to_id"), F.col("url").alias("to_url"))
    rows = pages.select(F.col("url").alias("from_url"), F.explode(F.array((F.col("page_id") * 7 + 3) % 50, (F.col("page_id") * 11 + 1) % 50)).alias("to_id"))
    return rows.join(to, "to_id").select("from_url", "to_url", F.lit("hyperlink").alias("link_type"), F.concat(F.lit("a"), F.col("to_id").cast("string")).alias("anchor_text"))


_PAGE_GRAPH = """
page_graph as (select p.url as from_url, q.url as to_url, 'hyperlink' as link_type, 'a' || cast(q.page_id as varchar) as anchor_text
  from (select url, unnest([(page_id * 7 + 3) % 50, (page_id * 11 + 1) % 50]) as to_id from pages) p join pages q on q.page_id = p.to_id)"""


def content_dedup_actions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.concat(F.lit("https://x.example.org/"), F.col("doc_id").cast("string")).alias("url"), E.content_hash(F.col("text")).alias("content_hash"),
        F.when(F.col("n_chars") > 60, 1).otherwise(0).alias("n_blocks"),
    )
    return dedup.page_actions(rows, MAIN_HOST)


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return html.block_tree(table(spark, d, "pages"))


def html_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return html.clean_text(table(spark, d, "pages"))


def html_dom_links(spark: SparkSession, d: str) -> DataFrame:
    return html.dom_links(table(spark, d, "pages"))


# Pages read by a stack machine in SQL, a token a round: each element and text with the numbers of the elements it lies in.
# Script and style are left out beforehand; the tables' pages have no other hidden text, and four kinds of entities.
_DOM = r"""
html_src as (select page_id, url, regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![^>]*>', '<br hidden>', 'g'), '<[^>]*>|[^<]+') as toks from pages),
tok as (select page_id, i, toks[i] as tok, lower(regexp_extract(toks[i], '^</?([a-zA-Z0-9]+)', 1)) as t, starts_with(toks[i], '</') as closing, starts_with(toks[i], '<') as is_tag
  from (select page_id, toks, unnest(range(1, len(toks) + 1)) as i from html_src)),
rule as materialized (select *, is_tag and not closing and t not in ('br', 'meta') as opening, case when t = 'li' then ['li', 'p']
  when t in ('p', 'div', 'article', 'section', 'header', 'footer', 'nav', 'ul', 'ol', 'table', 'form', 'main', 'aside', 'pre', 'blockquote', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') then ['p'] else [] end as shuts from tok),
run as (select page_id, 0::bigint as i, []::struct(t varchar, i bigint)[] as st, []::bigint[] as up from html_src
  union all select r.page_id, k.i, case when k.opening then list_append(k.cut, {'t': k.t, 'i': k.i}) else k.cut end, [x.i for x in k.cut]
  from run r join lateral (select q.*, case when not q.is_tag then r.st when q.closing then
      case when list_contains([x.t for x in r.st], q.t) then r.st[1:list_max([y for y in range(1, len(r.st) + 1) if r.st[y].t = q.t]) - 1] else r.st end
    else r.st[1:coalesce(list_max([y for y in range(1, len(r.st) + 1) if not list_contains(q.shuts, r.st[y].t)]), 0)] end as cut
    from rule q where q.page_id = r.page_id and q.i = r.i + 1) k on true),
dom as materialized (select r.page_id, r.i, r.up, k.tok, k.t, k.is_tag from run r join rule k using (page_id, i) where not k.closing and k.t <> 'meta' and k.tok <> '<br hidden>'),
txt as materialized (select page_id, i, up, replace(replace(replace(regexp_replace(said, '&amp;?', '&', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"') as text
  from (select *, trim(tok, E' \t\n\r\x0b\x0c') as said from dom where not is_tag) where said <> ''),
el as materialized (select page_id, i, up, up[-1] as parent, t, tok, nullif(regexp_extract(tok, ' id="([^"]*)"', 1), '') as ident from dom where is_tag)"""
_BLOCKS = rf"""{_DOM},
lay as (select el.page_id, el.i, coalesce(string_agg(text, ' ' order by txt.i), '') as text, max(txt.i) as post,
  coalesce(sum(len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]')) + len(regexp_extract_all(text, '[^\s\x{{a0}}]+'))), 0) as words
  from el left join txt on txt.page_id = el.page_id and list_contains(txt.up, el.i) group by 1, 2),
body as (select page_id, min(i) as b from el where t = 'body' group by 1),
kept as (select page_id, list(i) as ids from el where t in ('table', 'thead', 'tbody', 'tr', 'ul', 'ol', 'dl', 'pre', 'code') group by 1),
step as (select el.*, row_number() over (partition by page_id, parent, t order by i) - 1 as nth, count(ident) over (partition by page_id, parent, ident) as twins,
  row_number() over (partition by page_id, parent order by i) - 1 as child from el),
node as (select s.page_id, s.i, s.up, s.parent, s.child, l.text, l.words, l.post, b, len(s.up) - list_position(list_append(s.up, s.i), b) + 1 as depth,
  t || case when ident is null then '[' || nth || ']' when twins = 1 then '#' || ident else '#' || ident || '[' || nth || ']' end as step,
  words > 150 and not list_contains(coalesce(ids, []), s.i) as split, len(list_intersect(s.up, coalesce(ids, []))) = 0 as free
  from step s join lay l using (page_id, i) join body using (page_id) left join kept using (page_id)),
met as (select n.* from node n left join node p on p.page_id = n.page_id and p.i = n.parent where n.i = n.b or (list_contains(n.up, n.b) and n.free and p.words > 150)),
hit as (select * from met where (not split and words >= 20) or (split and not exists (select 1 from met k where k.page_id = met.page_id and k.parent = met.i and (k.split or k.words >= 20)))),
way as (select h.page_id, h.i, string_agg(a.step, '>' order by a.i) as path, string_agg(a.step, '>' order by a.i) filter (a.i <> h.i) as above
  from hit h join node a on a.page_id = h.page_id and (a.i = h.i or list_contains(h.up, a.i)) group by 1, 2),
head as (select h.page_id, h.i, string_agg(l.text, ' > ' order by l.i) as led from hit h join el on el.page_id = h.page_id and el.i <= h.post and el.t in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')
  join lay l on l.page_id = el.page_id and l.i = el.i where l.text <> '' group by 1, 2),
named as (select page_id, first(text order by i) as title from el join lay using (page_id, i) where t = 'title' group by 1)"""

QUERIES = {f.__name__: f for f in (
    url_parts_normalized, url_whitelist, url_drop_reason, url_drop_histogram, url_discovery, page_type_department, page_title_meta,
    error_page_reason, page_links_raw, page_links, link_stub_pages, crawl_frontier_bfs, crawl_seed_budget, related_links,
    priority_backfill, fetched_pages, frontier_scan, canonical_url_pick, link_rewrite, content_dedup_actions, html_blocks, html_clean_text, html_dom_links,
)}

_TYPES = """case when contains(url, '/people/academic-staff') or contains(url, '/people/academic-teaching-staff') then 'staff-list'
  when contains(url, '/people/academic-staff/') then 'personal-homepage' when contains(url, '/study/') or contains(url, '/programme/') then 'programme'
  when contains(url, '/course/') then 'course' when contains(url, '/admission') then 'admissions' when contains(url, '/fee') or contains(url, '/tuition') then 'fee'
  when contains(url, '/scholarship') then 'scholarship' else 'other' end"""

ORACLE_SQL = {
    "url_parts_normalized": f"select page_id, {_url()['scheme']} as scheme, {_url()['host']} as host, {_url()['norm']} as path from pages",
    "url_whitelist": f"select page_id, (ends_with({_url()['host']}, '.example.com') or {_url()['host']} = 'example.com' or {_url()['host']} = 'thther.example.org') as allowed from pages",
    "url_drop_reason": f"with {_VARIANTS}, {_reason_sql()} select page_id, n, reason from reasons",
    "url_drop_histogram": f"with {_VARIANTS}, {_reason_sql()} select coalesce(reason, 'keep') as reason, count(*) as n_urls from reasons group by all",
    "url_discovery": f"with {_VARIANTS}, {_reason_sql()} select url, min(page_id * 100 + n) as ordinal from reasons where reason is null group by url order by ordinal, url limit 120",
    "page_type_department": f"with {_VARIANTS} select page_id, n, {_TYPES} as page_type, coalesce(nullif(upper(regexp_extract(lower(url), '/([a-z]{{2,6}})/', 1)), ''), 'unknown') as department from variants",
    "page_title_meta": "select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, regexp_extract(html, '(?is)<meta[^>]*name=\"description\"[^>]*content=\"([^\"]*)\"', 1) as meta_description from pages",
    "error_page_reason": """with t as (select page_id, case page_id % 9 when 1 then 'Access Denied' when 2 then '403' when 3 then '!Error page' when 4 then 'Error 400 bad' when 5 then 'Page not found' when 6 then '404' when 7 then 'x' else 'Home' end as title,
  case page_id % 9 when 2 then 'Access denied by rule 403' when 7 then 'We could not find what you were looking for' when 8 then 'the page not found here' else 'plain text' end as body from pages),
  v as (select page_id, lower(title) as t, lower(title || chr(10) || '' || chr(10) || body) as p, body from t)
  select page_id, case when starts_with(t, 'access denied') or (contains(p, 'access denied') and contains(p, '403')) then 'access_denied'
  when contains(p, 'we could not find what you were looking for') then 'not_found_template' when starts_with(t, '!error') then 'error_title'
  when starts_with(t, 'error 400') or contains(p, '## http error 400') then 'http_400' when t in ('404', '404 not found', 'page not found') then 'not_found'
  when contains(p, 'page not found') and length(body) < 5000 then 'not_found' end as reason from v""",
    "page_links_raw": f"with {_HREF} select from_url, href, ordinal from raw_links",
    "page_links": f"with {_LINKS} select from_url, to_url, link_type from links",
    "link_stub_pages": f"with {_LINKS} select distinct to_url as url, '' as title, 'other' as page_type from links where to_url not in (select url from pages)",
    "crawl_frontier_bfs": f"""with recursive {_LINKS}, walk as (select url, 0 as depth from pages where page_id < 5
  union select l.to_url, w.depth + 1 from walk w join links l on l.from_url = w.url where w.depth < 3)
  select url, min(depth) as depth from walk group by url""",
    "crawl_seed_budget": """with r as (select page_id % 7 as seed_no, page_id as position, url, row_number() over (partition by page_id % 7 order by page_id) as k from pages),
  m as (select * from r where k <= 12), u as (select seed_no, count(*) as n from m group by 1),
  l as (select seed_no, 60 - coalesce(sum(n) over (order by seed_no rows between unbounded preceding and 1 preceding), 0) as rest from u)
  select m.seed_no, position, url from m join l using (seed_no) where k <= rest""",
    "related_links": f"""with {_LINKS}, named as (select from_url, to_url, regexp_extract(to_url, '([^/]*)$', 1) as anchor_text from links),
  s as (select page_id % 8 as query_id, url from pages where page_id < 40),
  o as (select query_id, to_url, min(anchor_text) as anchor_text from s join named on from_url = url where anchor_text <> '' group by 1, 2),
  f as (select * from o where not exists (select 1 from s where s.query_id = o.query_id and s.url = o.to_url))
  select query_id, to_url, anchor_text from (select *, row_number() over (partition by query_id order by to_url) as k from f) where k <= 15""",
    "priority_backfill": f"""with l as (select page_id, 'https://' || {_url()['host']} || '/study/' || page_id || case page_id % 3 when 0 then '/curriculum' when 1 then '/faq/' else '/news' end as url from pages)
  select distinct url from l where page_id % 3 < 2 and url not in (select url from l where page_id % 4 = 0)""",
    "fetched_pages": f"""select url, case when page_id % 3 = 1 then 't' || page_id when page_id % 4 = 1 then 'ot' || page_id else '' end as title,
  case when page_id % 6 = 1 then 'd' || page_id when page_id % 5 = 1 then 'od' || page_id else '' end as meta_description,
  coalesce(nullif(upper(regexp_extract(lower(url), '/([a-z]{{2,6}})/', 1)), ''), 'unknown') as department, {_TYPES} as page_type, '2024-01-01' as crawled_at, null as markdown, md5(html) as html_md5 from pages""",
    "frontier_scan": "select url from pages where page_id % 6 > 2",
    "canonical_url_pick": f"select substr({_url()['host']}, 1, 8) as grp, min({_key_sql('url')}).u as canonical_url from pages group by 1",
    "link_rewrite": f"""with {_PAGE_GRAPH}, h as (select url, substr(md5(substr({_url()['host']}, 1, 9)), 1, 16) as content_hash from pages),
  g as (select content_hash, count(*) as size, min({_key_sql('url')}).u as c from h group by 1),
  a as (select url, case when size >= 20 then 'drop' when size = 1 or url = c then 'keep' else 'mirror' end as action, c from h join g using (content_hash)),
  r as (select l.from_url, case when d.action = 'mirror' then d.c else l.to_url end as to_url, link_type, anchor_text from page_graph l
    join a s on s.url = l.from_url and s.action = 'keep' left join a d on d.url = l.to_url where coalesce(d.action, '') <> 'drop')
  select from_url, to_url, link_type, min(anchor_text) as anchor_text from r where from_url <> to_url group by 1, 2, 3""",
    "content_dedup_actions": f"""with r as (select 'https://x.example.org/' || cast(doc_id as varchar) as url, substr(sha256(text), 1, 16) as content_hash, case when n_chars > 60 then 1 else 0 end as n_blocks from documents),
  g as (select content_hash, count(*) as size, max(n_blocks) as most, min({_key_sql('url')}).u as c from r group by 1),
  j as (select url, r.content_hash, c, case when starts_with(r.content_hash, 'e3b0c44298') or most = 0 or size >= 20 then 'drop' when size = 1 or url = c then 'keep' else 'mirror' end as action from r join g on g.content_hash = r.content_hash)
  select url, content_hash, action, case when action <> 'drop' then c end as canonical_url from j""",
    "html_blocks": f"""with recursive {_BLOCKS}
  select md5(url || '|' || path) as block_id, h.text as content, path as html_tag_path, coalesce(led, title, '') as heading_context, cast(words as integer) as token_count, cast(depth as integer) as depth,
    case when depth > 0 then md5(url || '|' || above) end as parent_block_id, cast(case when depth > 0 then child else 0 end as integer) as child_index, url
  from hit h join way using (page_id, i) join html_src using (page_id) left join head using (page_id, i) left join named using (page_id)""",
    "html_clean_text": f"""with recursive {_DOM} select url, regexp_replace(coalesce(string_agg(text, ' ' order by i), ''), '[ \\t]+', ' ', 'g') as text
  from html_src left join txt using (page_id) group by page_id, url""",
    "html_dom_links": f"""with recursive {_DOM}, a as (select page_id, url, i, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace(regexp_extract(tok, 'href="([^"]*)"', 1), '[#?].*$', '') as to_url
    from el join html_src using (page_id) where t = 'a' and contains(tok, 'href="/')),
  f as (select page_id, url, to_url, min(i) as i from a group by 1, 2, 3)
  select url as from_url, to_url, left(coalesce((select string_agg(text, ' ' order by txt.i) from txt where txt.page_id = f.page_id and list_contains(txt.up, f.i)), ''), 200) as anchor_text,
    cast(row_number() over (partition by page_id order by i) - 1 as integer) as ordinal from f""",
}
