"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, chat, cover_tree, divergence, licenses, mixing, ngram_join, phrases, projections, quality, secrets, sharding, token_counts
from quillgraph.llm.common import table


#: Target shares of the corpus' tokens.
WEIGHTS = {"clean": 0.92, "junk": 0.05, "toxic": 0.03}


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep_ids=False)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WEIGHTS)


def op8_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.nearest(table(spark, sf_dir, "embeddings"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, order = token_counts.write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    counted = token_counts.count_tokens(files).join(order, ["file", "ordinal"])
    return counted.select("doc_id", "n_tokens", "closed", "file", "ordinal")


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts are made of the template's own control strings."""
    said = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(said)
    return chat.digest(chat.conversations_of(chat.segments(rows)))


def op12_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe_encoding_and_decoding": op5_bpe_encoding_and_decoding,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_approximate_nearest_neighbours": op8_approximate_nearest_neighbours,
    "op9_license_scans": op9_license_scans,
    "op10_token_counts": op10_token_counts,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_phrase_collocation_mining": op12_phrase_collocation_mining,
    "op13_source_divergence_audit": op13_source_divergence_audit,
}

# links to components: the smallest id that the links reach
_REACH = """
reach as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on w.a = r.b),
comp as (select a, least(a, min(b)) as component_id from reach group by a)"""

_SIMILAR = (
    r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g,
  case when len(w) >= 5 then 5 else len(w) end as k from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
both_ways as (select x as a, y as b from links union all select y, x from links),"""
    + _REACH
    + """
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id left join comp on comp.a = d.doc_id"""
)

_NEAR = (
    """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v),
links as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id < b.vec_id and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
both_ways as (select x as a, y as b from links union all select y, x from links),"""
    + _REACH
    + """,
n as (select a, count(*) as n from both_ways group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(component_id, e.vec_id) as component_id, coalesce(component_id, e.vec_id) = e.vec_id as kept from embeddings e left join n on n.a = e.vec_id left join comp on comp.a = e.vec_id"""
)


def _license_sql() -> str:
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = lambda t: f"list_filter(string_split_regex({t}, '{gap}'), lambda x: x <> '')"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split(' '))})" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({i}, '{label}', list_distinct(string_split('{t}', ' ')))" for i, (label, t) in enumerate(licenses.TEMPLATES))
    return f"""with d as (select doc_id, lower(coalesce(text, '')) as t from documents),
w as (select doc_id, t, {words('t')} as w from d),
ph as (select * from (values {phrases}) v(phrase, label, k)),
tm as (select * from (values {templates}) v(i, label, words)),
pl as (select doc_id, label, s - 1 as start from w, ph, range(1, 1000000) r(s) where s <= len(w) - k + 1 and contains(t, split_part(phrase, ' ', 1)) and array_to_string(w[s : s + k - 1], ' ') = phrase),
ln as (select doc_id, {words('line')} as w from (select doc_id, unnest(string_split(t, chr(10))) as line from d)),
mt as (select doc_id, label, max(len(list_intersect(tm.words, ln.w)) / len(tm.words)) as c from ln, tm where len(list_intersect(tm.words, ln.w)) >= ceil(0.8 * len(tm.words) - 1e-9) group by 1, 2),
b as (select doc_id, count(*) as n, min(start) as lo, max(start) as hi, string_agg(distinct label, ',' order by label) as labels from pl group by 1),
a as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from pl union all select doc_id, label from mt) group by 1),
m as (select doc_id, max(c) as c from mt group by 1)
select w.doc_id, len(w.w) as n_words, coalesce(b.n, 0) as n_base, b.lo as first_word, b.hi as last_word, coalesce(b.labels, '') as base_labels, coalesce(a.labels, '') as labels,
  case when b.n > 0 then 1.0 else coalesce(m.c, 0.0) end::double as score
from w left join b using (doc_id) left join a using (doc_id) left join m using (doc_id)"""


_CHAT = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, row_number() over w as i, lag(role) over w as before,
  length(regexp_replace(regexp_replace(text, '(\[)(\\*)(/?(SYS|INST|SAYS)\]|ROLE\])', '\1\\\2\3', 'g'), '(<)(\\*)(/?s>)', '\1\\\2\3', 'g'))
    + case role when 'system' then 13 when 'user' then 15 when 'assistant' then 5 else 24 + length(role) end as width
  from c window w as (partition by conv_id order by turn nulls first, role, text)),
b as (select conv_id, min(i) as i from t where not case when before is null then role in ('system', 'user')
  when before = 'system' or before = 'assistant' then role = 'user' when before = 'user' then role = 'assistant' else false end group by 1)
select t.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by t.i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by t.i) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(width))::bigint as formatted_chars, any_value(b.i) is null and max_by(role, t.i) = 'assistant' as valid,
  coalesce(any_value(b.i) - 1, count(*)) as kept_turns
from t left join b on b.conv_id is not distinct from t.conv_id group by t.conv_id"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PHRASES = rf"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w where len(w) > 0 group by 1),
x as (select lang, id, unnest(w) as w, generate_subscripts(w, 1) as i from w),
y as (select lang, w as a, lead(w) over o as b, lead(w, 2) over o as c from x window o as (partition by id order by i)),
g as (select lang, 1 as k, a as phrase from y union all select lang, 2, a || ' ' || b from y where b is not null union all select lang, 3, a || ' ' || b || ' ' || c from y where c is not null),
f as (select lang, k, phrase, count(*) as f from g group by all),
c as (select *, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
cut as (select c.lang, c.phrase, c.k, c.f as a, j, l.f as l, r.f as r, ((1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f))::bigint as score
  from c join (values (1), (2)) v(j) on j < c.k
  join f l on l.lang = c.lang and l.k = j and l.phrase = array_to_string(c.w[1 : j], ' ')
  join f r on r.lang = c.lang and r.k = c.k - j and r.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
low as (select *, row_number() over (partition by lang, phrase order by score, j) as best from cut),
longer as (select lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) as phrase, f from c where k = 3),
gone as (select distinct low.lang, low.phrase from low join longer on longer.lang = low.lang and longer.phrase = low.phrase where low.k = 2 and 100 * longer.f >= 50 * low.a),
kept as (select low.*, row_number() over (partition by low.lang order by score desc, a desc, low.phrase) as rank from low anti join gone on gone.lang = low.lang and gone.phrase = low.phrase where best = 1)
select kept.lang, rank, phrase, a, l, r, n, score from kept join n on n.lang = kept.lang where rank <= 2000"""

_AUDIT = rf"""with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOW} as t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by 1, 2 having count(distinct id) >= 10),
v as (select lang, count(*) as v, sum(n)::bigint as total from kept group by 1),
g as (select distinct lang, source from d),
c as (select w.lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
gt as (select lang, source, coalesce(sum(n), 0)::bigint as total from g left join c using (lang, source) group by all),
gp as (select gt.lang, gt.source, kept.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * v.v))::bigint as p
  from gt join kept on kept.lang = gt.lang join v on v.lang = gt.lang left join c on c.lang = gt.lang and c.source = gt.source and c.term = kept.term),
lp as (select kept.lang, term, (1 + (1000000000::hugeint * (n + 2)) // (total + 2 * v))::bigint as q from kept join v on v.lang = kept.lang),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pv.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
tr as (select gp.lang, gp.source, 'term' as part, gp.term as item, (p - q) * (p - q) // (p + q) as value from gp join lp on lp.lang = gp.lang and lp.term = gp.term where gp.n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pr union all select * from tr))
select * from r where part = 'pair' or rank <= 10"""


#: For operators that SQL can express; the others are held against brute force in tests.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": _SIMILAR,
    "op6_embedding_near_dedup": _NEAR,
    "op9_license_scans": _license_sql(),
    "op11_chat_formatting": _CHAT,
    "op12_phrase_collocation_mining": _PHRASES,
    "op13_source_divergence_audit": _AUDIT,
}
