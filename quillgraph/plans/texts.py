"""Queries over documents, blocks and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import expr as E
from quillgraph.operators import dedup, extraction, kg, lookup, providers, resolution, router
from quillgraph.sources.tables import table

MAIN_HOST = "thther.example.org"


def doc_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blocks: (url, html_tag_path, block_id, content, child_index, tokens)."""
    n = F.col("doc_id")
    url = F.concat(F.when(n % 3 == 0, "http://").otherwise("https://"), F.lit("h"), (n % 40).cast("string"), F.lit(".example.org/"), (n % 80).cast("string"))
    return table(spark, d, "documents").select(
        url.alias("url"), F.concat(F.lit("html[0]>body[0]>p["), n.cast("string"), F.lit("]")).alias("html_tag_path"),
        F.concat(F.lit("b"), n.cast("string")).alias("block_id"), F.col("text").alias("content"), n.alias("child_index"),
    )


_BLOCKS = """
blocks as (select case when doc_id % 3 = 0 then 'http://' else 'https://' end || 'h' || cast(doc_id % 40 as varchar) || '.example.org/' || cast(doc_id % 80 as varchar) as url,
  'html[0]>body[0]>p[' || cast(doc_id as varchar) || ']' as html_tag_path, 'b' || cast(doc_id as varchar) as block_id, text as content, doc_id as child_index from documents)"""


def word_count_cjk(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit(" 计算 AI lab"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", E.word_count(text).alias("n_words"))


def ascii_token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = E.ascii_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def identity_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", E.content_hash(t).alias("content_hash"), E.block_id(F.col("source"), F.lit("body[0]")).alias("block_id"),
        E.entity_id(F.col("source")).alias("entity_id"), E.relation_id(F.col("source"), F.col("lang"), F.lit("in")).alias("relation_id"),
        F.substring(F.md5("source"), 1, 12).alias("page_uid"),
    )


def block_boilerplate_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 8
    path = F.when(n == 0, "html[0]>body[0]>nav[0]>ul[0]").when(n == 1, "html[0]>body[0]>navbar[0]").otherwise("html[0]>body[0]>p[0]")
    content = F.when(n == 2, "We use cookies here; see privacy").when(n == 3, "Copyright © 2024").when(n == 4, "open close menu back / open x y").when(n == 5, "  ").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", E.is_boilerplate(path, content).alias("is_boilerplate"))


def block_content_remap(spark: SparkSession, d: str) -> DataFrame:
    return dedup.block_remap(doc_blocks(spark, d), MAIN_HOST)


def mirror_block_remap(spark: SparkSession, d: str) -> DataFrame:
    blocks = doc_blocks(spark, d)
    urls = blocks.groupBy("url").agg(F.count("*").alias("n_blocks")).withColumn("content_hash", F.substring(F.md5(F.substring("url", -2, 2)), 1, 16))
    return dedup.mirror_remap(blocks, dedup.page_actions(urls, MAIN_HOST))


def remap_compose(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select("doc_id")
    n = F.col("doc_id")
    first = ids.where("doc_id % 3 = 0").select(n.alias("old_id"), (n + 1).alias("new_id"))
    second = ids.where("doc_id % 3 = 1").select(n.alias("old_id"), (n + 1).alias("new_id"))
    third = ids.where("doc_id % 9 = 0").select(n.alias("old_id"), (n + 2).alias("new_id"))
    return dedup.compose_remaps([first, second, third])


def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring documents of a source, by id: their token overlap."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, d, "documents").select("doc_id", "source", E.overlap_tokens(F.substring("text", 1, 1500)).alias("t"))
    rows = rows.withColumns({"other": F.lead("doc_id").over(w), "o": F.lead("t").over(w)}).where("other is not null")
    return rows.select("doc_id", "other", F.round(E.jaccard(F.col("t"), F.col("o")), 6).alias("jaccard"))


def router_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return router.route(_questions(spark, d)).select("query_id", "mode", "confidence", "rule")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id") % 11
    lead = ["which professors do NLP?", "library hours", "MSc A vs MSc B", "admission and tuition fee", "who does research with Prof. Li", "哪些老师", "two researchers share topics",
            "What is the fee and the deadline respectively", "how does A compare with B", "joint publication of X",
            "Which professors work with Prof. Li and what are their offices respectively"]
    head = F.lit("")
    for i, t in enumerate(lead):
        head = F.when(n == i, t).otherwise(head)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(head, F.lit(" "), "text").alias("text"))


def _lead_sql() -> str:
    lead = ["which professors do NLP?", "library hours", "MSc A vs MSc B", "admission and tuition fee", "who does research with Prof. Li", "哪些老师", "two researchers share topics",
            "What is the fee and the deadline respectively", "how does A compare with B", "joint publication of X",
            "Which professors work with Prof. Li and what are their offices respectively"]
    cases = " ".join(f"when {i} then '{t}'" for i, t in enumerate(lead))
    return f"questions as (select item_id as query_id, case item_id % 11 {cases} end || ' ' || text as text from benchmark)"


def acronym_expand(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = nations.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("variant"), F.concat(F.lit("Nation "), "r_name").alias("canonical"))
    n = F.col("item_id")
    text = F.concat(F.lit("Is n3 or N"), (n % 30).cast("string"), F.lit(" near N7"), F.when(n % 4 == 0, " in Nation AFRICA").otherwise(""))
    rows = table(spark, d, "benchmark").select(n.alias("query_id"), text.alias("text"))
    return router.expand_acronyms(rows, aliases).select("query_id", "expanded")


def history_window(spark: SparkSession, d: str) -> DataFrame:
    out = router.history(table(spark, d, "conversations"))
    return out.select("conv_id", "n", F.md5("user_text").alias("user_md5"), F.md5("assistant_text").alias("assistant_md5"))


def contextual_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the next turn, marked and quoted as a model does, for its rewrite; long, empty and missing ones fall back."""
    turns = table(spark, d, "conversations")
    follow = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rewrite = F.concat(F.when(F.col("turn") % 4 == 0, F.lit("Standalone question: \"")).otherwise(F.lit("rewritten:  '")), follow, F.when(F.col("turn") % 4 == 0, F.lit('" ')).otherwise(F.lit("'")))
    asked = turns.select("conv_id", "turn", "role", "text", rewrite.alias("rewrite")).where("role = 'user'")
    return asked.select("conv_id", "turn", F.md5(router.contextual(F.col("text"), F.col("rewrite"))).alias("question_md5"), (router.contextual(F.col("text"), F.col("rewrite")) == F.col("text")).alias("kept"))


def page_block_refs(spark: SparkSession, d: str) -> DataFrame:
    """Labels that a model gives back, mapped to the lines of an order; lines returned are blank, and labels run past the last line."""
    t = table(spark, d, "lineitem")
    content = F.when(F.col("l_returnflag") == "R", F.lit("  ")).otherwise(F.col("l_linestatus"))
    blocks = t.select(F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("block_id"), content.alias("content"))
    return kg.block_refs(t.select(F.col("l_orderkey").alias("url"), F.concat(F.lit(" b"), (F.col("l_linenumber") + 1).cast("string")).alias("ref")), blocks)


def suggestion_sanitize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'")
    s = F.concat(F.lit(' "'), F.substring("text", 1, 12), F.lit("?\" "))
    return router.suggestions(rows.select(F.col("conv_id").alias("query_id"), F.lit("what now").alias("query"), F.col("turn").alias("position"), s.alias("suggestion")))


def entity_norm_exact_merge(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    lead = F.when(n % 4 == 0, "Dr. ").when(n % 4 == 1, "PROF ").otherwise("")
    name = F.concat(lead, F.when(n % 3 == 0, F.regexp_replace("p_name", " ", "-")).otherwise(F.col("p_name")), F.when(n % 5 == 0, " (Hons)").otherwise(" & co"))
    return kg.exact_merge(table(spark, d, "part").select(name.alias("name"), F.col("p_type").alias("kind"), n.alias("ordinal")))


def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    aliases = table(spark, d, "nation").select(F.concat(F.lit("N "), F.col("n_nationkey").cast("string")).alias("variant"), F.col("n_name").alias("canonical"), F.col("n_nationkey").alias("ordinal"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), F.concat(F.lit(" n "), (F.col("c_nationkey") + F.col("c_custkey") % 3).cast("string")).alias("name"))
    return kg.with_aliases(rows, aliases).select("ordinal", "canonical")


def type_and_strength(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 7
    raw = F.when(n == 0, " person ").when(n == 1, "UNIVERSITY DEPARTMENT").when(n == 2, "LOCATION").when(n == 3, "event").otherwise("some Course thing")
    s = F.when(n == 0, "12").when(n == 1, "abc").when(n == 2, "0").otherwise(n.cast("string"))
    return table(spark, d, "events").select("event_id", E.entity_type(raw).alias("kind"), E.strength(s).alias("strength"))


def fuzzy_top5(spark: SparkSession, d: str) -> DataFrame:
    return kg.fuzzy_top(table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name")).distinct())


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """The first words of each document as a mention of it, under a type by language, with a vector of its tokens."""
    words = F.filter(F.split(F.substring("text", 1, 400), "\\s+"), lambda w: w != "")
    kind = F.when(F.col("lang") == "en", "PERSON").when(F.col("lang") == "de", "DEPARTMENT").otherwise("COURSE")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.array_join(F.slice(words, 1, 9), " ").alias("name"), kind.alias("kind"))
    nations = table(spark, d, "nation").select(F.col("n_name").alias("variant"), F.concat(F.lit("Nation "), F.initcap("n_name")).alias("canonical"), F.col("n_nationkey").alias("ordinal"))
    named = kg.with_aliases(providers.HashingEmbedder(64).embed(rows, "name"), nations)
    return named.select("ordinal", "name", "kind", "canonical", F.col("embedding").alias("vec"))


def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve(_mentions(spark, d)).withColumn("score", F.round("score", 6))


def entity_merge_log(spark: SparkSession, d: str) -> DataFrame:
    """What the resolver did, by kind of merge."""
    return lookup.merge_report(entity_resolve(spark, d))


def relation_texts(spark: SparkSession, d: str) -> DataFrame:
    kw = F.when(F.col("p_size") > 20, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", kg.relation_text(F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.lit("makes"), kw).alias("value"), kg.entity_text(F.col("p_name"), F.col("p_brand")).alias("entity_value"))


def topic_keywords(spark: SparkSession, d: str) -> DataFrame:
    return kg.topic_keywords(table(spark, d, "part").select(F.split("p_name", " ").alias("keywords")))


def query_decompose(spark: SparkSession, d: str) -> DataFrame:
    return providers.decompose(_questions(spark, d))


def _reply(attempt: F.Column) -> F.Column:
    """A model's reply about an item: whole at the third attempt, before that broken in one of seven ways by its number."""
    n = F.col("item_id")
    name = F.concat(F.lit("Item, }] "), n.cast("string"))
    rest = F.concat(F.lit('", "type": "person", "description": "said \\"so\\""}, {"name": " ", "type": "COURSE"}], "relations": [{"source": "'), name, F.lit('", "target": "B", "strength": "'), (n % 14).cast("string"), F.lit('", "keywords": ["k1", "k2"'))
    whole = F.concat(F.lit('{"entities": [{"name": "'), name, rest)
    full = F.concat(whole, F.lit("]}]}"))
    broken = (
        F.when(n % 7 == 0, full).when(n % 7 == 1, F.concat(F.lit("Here it is:\n```json\n"), full, F.lit("\n```")))
        .when(n % 7 == 2, F.concat(whole, F.lit(",],}, ],}"))).when(n % 7 == 3, whole)
        .when(n % 7 == 4, F.concat(whole, F.lit(', "k3 cut'))).when(n % 7 == 5, F.concat(full, F.lit("\n\nI hope this helps {you}.")))
        .otherwise("I cannot do that.")
    )
    return F.when(attempt >= 2, full).otherwise(broken)


def extraction_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies about all benchmark items, most of them broken, read and where need be asked again."""
    items = table(spark, d, "benchmark").withColumnRenamed("item_id", "block_id")
    ask = lambda rows, attempt: rows.withColumnRenamed("block_id", "item_id").select(F.col("item_id").alias("block_id"), _reply(F.lit(attempt)).alias("reply"))
    out = extraction.extracted(items, ask)
    return out.select(
        "block_id", F.array_join("entities.name", "|").alias("names"), F.array_join("entities.type", "|").alias("types"), F.array_join("entities.description", "|").alias("descriptions"),
        F.array_join(F.transform("relations", lambda x: F.concat_ws(">", x["source"], x["target"], x["strength"].cast("string"), F.array_join(x["keywords"], "+"))), "|").alias("relations"),
        "readable", "attempt",
    )


QUERIES = {f.__name__: f for f in (
    word_count_cjk, ascii_token_counts, identity_hashes, block_boilerplate_filter, block_content_remap, mirror_block_remap, remap_compose,
    token_jaccard_pairs, router_heuristic, acronym_expand, history_window, contextual_questions, page_block_refs, suggestion_sanitize, entity_norm_exact_merge, alias_lookup,
    type_and_strength, fuzzy_top5, entity_resolve, entity_merge_log, relation_texts, topic_keywords, query_decompose, extraction_parse,
)}


def _patterns(col: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({col}, '{p}')" for p in patterns) + ")"


_KEY = """{'s': case when starts_with(url, 'https') then 0 else 1 end, 'h': 1, 't': 0, 'l': length(url), 'u': url}"""
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^(?:dr|prof|professor|mr|mrs|ms|miss|sir|madam)\.?\s+', ''), '\s*&\s*', ' and ', 'g'), '-', ' ', 'g'), '\s+\(', '(', 'g'), '\s+', ' ', 'g'))"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(substr(text, 1, 1500)), '[a-z0-9\\x{4e00}-\\x{9fff}]+'), lambda x: length(x) >= 2))"

ORACLE_SQL = {
    "word_count_cjk": r"""with t as (select doc_id, text || case when doc_id % 5 = 0 then ' 计算 AI lab' else '' end as t from documents)
  select doc_id, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')) + len(regexp_extract_all(t, '\S+')) as n_words from t""",
    "ascii_token_counts": "select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as n_distinct from documents",
    "identity_hashes": """select doc_id, substr(sha256(text), 1, 16) as content_hash, md5(source || '|body[0]') as block_id, md5(lower(trim(source))) as entity_id,
  md5(source || '|' || lang || '|in') as relation_id, substr(md5(source), 1, 12) as page_uid from documents""",
    "block_boilerplate_filter": r"""with t as (select doc_id, case doc_id % 8 when 0 then 'html[0]>body[0]>nav[0]>ul[0]' when 1 then 'html[0]>body[0]>navbar[0]' else 'html[0]>body[0]>p[0]' end as path,
  case doc_id % 8 when 2 then 'We use cookies here; see privacy' when 3 then 'Copyright © 2024' when 4 then 'open close menu back / open x y' when 5 then '  ' else substr(text, 1, 200) end as content from documents),
  w as (select *, list_filter(string_split_regex(lower(content), '\s+'), lambda x: x <> '') as tok from t),
  v as (select *, len(tok) as n, len(list_filter(tok, lambda x: x in ('open', 'close', 'menu', 'back', '/'))) as m from w)
  select doc_id, (regexp_matches(path, '>(header|footer|nav)') or regexp_matches(content, '(?i)we use cookies?\b.*\bprivacy\b') or regexp_matches(content, '(?i)your browser is not the latest version')
    or regexp_matches(content, '(?i)copyright\s*©') or regexp_matches(content, '(?i)privacy policy\s*(statement)?.*terms of use') or n = 0 or (m > 4 and m / n > 0.15)) as is_boilerplate from v""",
    "block_content_remap": f"""with {_BLOCKS}, h as (select *, substr(sha256(content), 1, 16) as h, {{'k': {_KEY}, 'p': html_tag_path, 'b': block_id}} as k from blocks),
  g as (select h, min(k).b as new_id from h group by h having count(distinct url) >= 2)
  select block_id as old_id, new_id from h join g using (h) where block_id <> new_id""",
    "mirror_block_remap": f"""with {_BLOCKS}, u as (select url, count(*) as n_blocks, substr(md5(right(url, 2)), 1, 16) as content_hash from blocks group by 1),
  g as (select content_hash, count(*) as size, min({_KEY}).u as c from u group by 1),
  m as (select url, c from u join g using (content_hash) where size < 20 and size > 1 and url <> c),
  t as (select url as c, content, min({{'i': child_index, 'b': block_id}}).b as new_id from blocks group by 1, 2)
  select b.block_id as old_id, t.new_id from blocks b join m on m.url = b.url join t on t.c = m.c and t.content = b.content""",
    "remap_compose": """with recursive r as (select doc_id as old_id, case when doc_id % 9 = 0 then doc_id + 2 else doc_id + 1 end as new_id from documents where doc_id % 3 in (0, 1)),
  w as (select old_id, new_id, 0 as n from r union all select w.old_id, r.new_id, n + 1 from w join r on r.old_id = w.new_id where n < 20)
  select old_id, max_by(new_id, n) as new_id from w group by old_id""",
    "token_jaccard_pairs": f"""with t as (select doc_id, source, {_TOKENS} as t from documents),
  p as (select doc_id, t, lead(doc_id) over w as other, lead(t) over w as o from t window w as (partition by source order by doc_id)),
  q as (select doc_id, other, len(list_intersect(t, o)) as i, len(t) + len(o) as s from p where other is not null)
  select doc_id, other, case when s - i > 0 then round(i / (s - i), 6) else 0.0 end as jaccard from q""",
    "extraction_parse": """select item_id as block_id, 'Item, }] ' || item_id as names, 'PERSON' as types, 'said "so"' as descriptions,
  'Item, }] ' || item_id || '>B>' || greatest(1, least(10, item_id % 14)) || '>k1+k2' || case when item_id % 7 = 4 then '+k3 cut' else '' end as relations, true as readable, case when item_id % 7 = 6 then 2 else 0 end as attempt from benchmark""",
    "router_heuristic": f"""with {_lead_sql()}, q0 as (select query_id, lower(trim(text)) as q from questions),
  m0 as (select query_id, {_patterns('q', router.REASONING)} as l, {_patterns('q', router.PERSON)} as p, {_patterns('q', router.NAVIGATION)} as n, {_patterns('q', router.COMPARISON)} as x, {_patterns('q', router.SHARED_RESEARCHER)} as s from q0),
  m as (select *, l and not p as c, n and not (l and p) as b from m0)
  select query_id, case when c then 'mode_c' when b or x or s then 'mode_b' else 'mode_a' end as mode,
  case when c or b then 1.0 when x or s then 0.55 else 0.5 end::double as confidence, case when c or b then 'heuristic' when x then 'comparison' when s then 'shared' else 'default' end as rule from m""",
    "acronym_expand": r"""with a as (select 'N' || cast(n_nationkey as varchar) as variant, 'Nation ' || r_name as canonical from nation join region on n_regionkey = r_regionkey),
  q as (select item_id as query_id, 'Is n3 or N' || cast(item_id % 30 as varchar) || ' near N7' || case when item_id % 4 = 0 then ' in Nation AFRICA' else '' end as text from benchmark),
  f as (select query_id, canonical, min(variant) as variant from q, a where regexp_matches(text, case when length(variant) <= 3 then '' else '(?i)' end || '\b' || variant || '\b') and not contains(lower(text), lower(canonical)) group by 1, 2),
  l as (select query_id, string_agg(variant || ' = ' || canonical, '; ' order by variant || ' = ' || canonical) as l from f group by 1)
  select query_id, text || case when l is null then '' else ' (' || l || ')' end as expanded from q left join l using (query_id)""",
    "history_window": """with t as (select *, lag(role) over w as pr, lag(text) over w as pt from conversations where role in ('user', 'assistant') window w as (partition by conv_id order by turn)),
  p as (select *, cast(row_number() over (partition by conv_id order by turn desc) as integer) as n from t where role = 'assistant' and pr = 'user' and trim(text) <> '')
  select conv_id, n, md5(pt) as user_md5, md5(text) as assistant_md5 from p where n <= 3""",
    "contextual_questions": r"""with t as (select conv_id, turn, role, text, case when turn % 4 = 0 then 'Standalone question: "' else 'rewritten:  ''' end || lead(text) over (partition by conv_id order by turn) || case when turn % 4 = 0 then '" ' else '''' end as rw from conversations),
  c as (select *, trim(regexp_replace(regexp_replace(trim(rw), '(?i)^(rewritten|standalone)( question)?:\s*', ''), '^["'']+|["'']+$', '', 'g')) as clean from t where role = 'user'),
  o as (select conv_id, turn, text, case when coalesce(clean = '' or length(clean) > 300 or clean = text, true) then text else clean end as q from c)
  select conv_id, turn, md5(q) as question_md5, q = text as kept from o""",
    "page_block_refs": """with b as (select l_orderkey as url, 'B' || l_linenumber as label, l_partkey as block_id from lineitem where l_returnflag <> 'R')
  select r.l_orderkey as url, ' b' || (r.l_linenumber + 1) as ref, block_id from lineitem r join b on b.url = r.l_orderkey and b.label = 'B' || (r.l_linenumber + 1)""",
    "suggestion_sanitize": """with r as (select conv_id as query_id, turn as position, trim(regexp_replace(trim(' "' || substr(text, 1, 12) || '?" '), '^["'']+|["'']+$', '', 'g')) as s from conversations where role = 'user'),
  u as (select query_id, lower(s) as k, min({'p': position, 's': s}) as m from r where length(s) between 8 and 120 and lower(s) <> 'what now' group by 1, 2),
  o as (select query_id, cast(row_number() over (partition by query_id order by m.p, m.s) as integer) as n, m.s as suggestion from u)
  select query_id, n, suggestion from o where n <= 3""",
    "entity_norm_exact_merge": f"""with m as (select case p_partkey % 4 when 0 then 'Dr. ' when 1 then 'PROF ' else '' end || case when p_partkey % 3 = 0 then replace(p_name, ' ', '-') else p_name end || case when p_partkey % 5 = 0 then ' (Hons)' else ' & co' end as name, p_type as kind, p_partkey as ordinal from part)
  select {_NORM} as norm, kind, count(*) as n, min_by(name, ordinal) as entity_name from m group by 1, 2""",
    "alias_lookup": """select c_custkey as ordinal, n_name as canonical from customer left join nation on n_nationkey = c_nationkey + c_custkey % 3""",
    "type_and_strength": """with t as (select event_id, case event_id % 7 when 0 then 'PERSON' when 1 then 'UNIVERSITY DEPARTMENT' when 2 then 'LOCATION' when 3 then 'EVENT' else 'SOME COURSE THING' end as v,
  case event_id % 7 when 0 then '12' when 1 then 'abc' when 2 then '0' else cast(event_id % 7 as varchar) end as s from events)
  select event_id, case when v in ('PERSON', 'EVENT') then v when contains(v, 'COURSE') then 'COURSE' when contains(v, 'DEPARTMENT') then 'DEPARTMENT' else 'RESEARCH_AREA' end as kind,
  greatest(1, least(10, coalesce(try_cast(s as integer), 5))) as strength from t""",
    "relation_texts": """select p_partkey, p_brand || ' -> ' || p_name || ' (' || p_type || '): makes' || case when p_size > 20 then '. Topics: ' || replace(p_name, ' ', ', ') else '' end as value, p_name || ': ' || p_brand as entity_value from part""",
    "topic_keywords": "select distinct lower(trim(k)) as keyword from (select unnest(string_split(p_name, ' ')) as k from part) where length(lower(trim(k))) > 2",
    "query_decompose": rf"""with {_lead_sql()}, p as (select query_id, list_filter(string_split_regex(text, '(?i)\s+and\s+|;'), lambda x: trim(x) <> '')[1:4] as parts from questions)
  select query_id, cast(i - 1 as integer) as n, trim(parts[i]) as sub_query from p, range(1, 5) r(i) where i <= len(parts)""",
}
