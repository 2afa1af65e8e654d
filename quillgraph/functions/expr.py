"""Column expressions: urls, text, hashes, scores. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.config import ENTITY_TYPES, PAGE_TYPES, ScoringParams, UrlRules

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_match(rules: list[tuple[Column, object]], default: Column | None = None) -> Column:
    """The value of the first rule that holds."""
    out = default if default is not None else F.lit(None).cast("string")
    for cond, value in reversed(rules):
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


# urls
def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, "[#?].*$", "")


def normalized_path(path: Column) -> Column:
    bare = F.regexp_replace(F.lower(path), "/+$", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def host_allowed(host: Column, patterns: tuple[str, ...]) -> Column:
    """``*.x`` stands for x and every host below it; other patterns for themselves."""
    conds = [host.endswith(p[1:]) | (host == p[2:]) if p.startswith("*.") else host == p for p in patterns]
    return any_of(conds)


def drop_reason(url: Column, rules: UrlRules) -> Column:
    """The first rule that speaks against crawling ``url``; null to keep it."""
    host, path = url_host(url), normalized_path(url_path(url))
    below = lambda h, s: (h == s) | h.endswith("." + s)
    under = lambda p, s: (p == s) | p.startswith(s + "/")
    segment = F.regexp_extract(path, "^/([^/]*)", 1)
    cascade: list[tuple[Column, object]] = [
        (any_of([below(host, s) for s in rules.host_suffixes]), "blocked_host"),
        (any_of([below(host, s) & under(path, p) for s, p in rules.host_path_prefixes]), "blocked_path"),
        (segment.isin(*rules.language_prefixes), "lang_mirror"),
        (any_of([path.endswith(e) for e in rules.extensions]), "asset"),
        (path.isin(*rules.exact_paths), "boilerplate"),
        (any_of([under(path, p) for p in rules.path_prefixes]), "blocked_path"),
    ]
    # the first dated pattern that matches decides alone
    years = [F.regexp_extract(path, p, 1) for p in rules.dated_patterns]
    dated = F.coalesce(*[F.nullif(y, F.lit("")) for y in years])
    cascade.append((F.coalesce(dated.cast("int") < rules.min_year, F.lit(False)), "pre_min_year"))
    numbers = F.regexp_extract_all(path, F.lit(r"\d+"), F.lit(0))
    old = F.exists(numbers, lambda x: (F.length(x) == 4) & F.left(x, F.lit(2)).isin("19", "20") & (x.cast("int") < rules.min_year))
    cascade.append((old, "pre_min_year"))
    return first_match(cascade)


def page_type(url: Column) -> Column:
    return first_match([(any_of([F.contains(url, F.lit(s)) for s in subs]), name) for name, subs in PAGE_TYPES], F.lit("other"))


def department(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), r"/([a-z]{2,6})/", 1)
    return F.when(found == "", F.lit("unknown")).otherwise(F.upper(found))


def canonical_key(url: Column, main_host: str) -> Column:
    """Smaller is better: https, the main host, no trailing slash, shorter, then the url itself."""
    path = url_path(url)
    slash = path.endswith("/") & (path != "/")
    return F.struct(
        F.when(url_scheme(url) == "https", 0).otherwise(1).alias("s"),
        F.when(url_host(url) == main_host, 0).otherwise(1).alias("h"),
        slash.cast("int").alias("t"), F.length(url).alias("l"), url.alias("u"),
    )


def error_page_reason(title: Column, markdown: Column, body: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    text = F.coalesce(F.nullif(markdown, F.lit("")), body, F.lit(""))
    preview = F.lower(F.concat_ws("\n", title, F.substring(F.coalesce(markdown, F.lit("")), 1, 2000), F.substring(F.coalesce(body, F.lit("")), 1, 2000)))
    has = lambda s: F.contains(preview, F.lit(s))
    # fixed values: the titles and phrases of error pages, in the order in which they are tried
    return first_match([
        (t.startswith("access denied") | (has("access denied") & has("403")), "access_denied"),
        (has("we could not find what you were looking for"), "not_found_template"),
        (t.startswith("!error"), "error_title"),
        (t.startswith("error 400") | has("## http error 400"), "http_400"),
        (t.isin("404", "404 not found", "page not found"), "not_found"),
        (has("page not found") & (F.length(text) < 5000), "not_found"),
    ])


# text
def word_count(text: Column) -> Column:
    """Words by white space, and every CJK character once more."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit("[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]")) + F.regexp_count(t, F.lit("\\S+"))


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def overlap_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two characters or more, CJK included."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9\\x{4e00}-\\x{9fff}]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def is_boilerplate(path: Column, content: Column) -> Column:
    """A block of a page's frame: by place, by phrase, empty, or mostly menu words."""
    tokens = F.filter(F.split(F.lower(content), "\\s+"), lambda x: x != "")
    # fixed values: menu words, places and phrases of a frame
    menu = F.size(F.filter(tokens, lambda x: x.isin("open", "close", "menu", "back", "/")))
    place = path.rlike(">(header|footer|nav)")
    phrase = any_of([
        content.rlike("(?i)we use cookies?\\b.*\\bprivacy\\b"), content.rlike("(?i)your browser is not the latest version"),
        content.rlike("(?i)copyright\\s*©"), content.rlike("(?i)privacy policy\\s*(statement)?.*terms of use"),
    ])
    return place | phrase | (F.size(tokens) == 0) | ((menu > 4) & (menu / F.size(tokens) > 0.15))


def normalized_name(name: Column) -> Column:
    n = F.lower(F.trim(name))
    n = F.regexp_replace(n, "^(?:dr|prof|professor|mr|mrs|ms|miss|sir|madam)\\.?\\s+", "")
    n = F.regexp_replace(n, "\\s*&\\s*", " and ")
    n = F.regexp_replace(n, "-", " ")
    n = F.regexp_replace(n, "\\s+\\(", "(")
    return F.trim(F.regexp_replace(n, "\\s+", " "))


def entity_type(value: Column) -> Column:
    """Exact type, else the first type whose name occurs in the value, else RESEARCH_AREA."""
    v = F.upper(F.trim(value))
    rules: list[tuple[Column, object]] = [(v.isin(*ENTITY_TYPES), v)]
    rules += [(F.contains(v, F.lit(t)), t) for t in ENTITY_TYPES]
    return first_match(rules, F.lit("RESEARCH_AREA"))


def strength(value: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(value.try_cast("int"), F.lit(5))))


# identities
def block_id(url: Column, path: Column) -> Column:
    return F.md5(F.concat_ws("|", url, path))


def entity_id(name: Column) -> Column:
    return F.md5(F.lower(F.trim(name)))


def relation_id(source: Column, target: Column, kind: Column) -> Column:
    return F.md5(F.concat_ws("|", source, target, kind))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


# scores
def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def block_score(cos: Column, coverage: Column, tokens: Column, p: ScoringParams = ScoringParams()) -> Column:
    cover = F.least(coverage, F.lit(p.coverage_cap)) / F.lit(float(p.coverage_cap))
    brevity = F.greatest(F.lit(0.0), 1.0 - F.coalesce(tokens, F.lit(p.default_tokens)) / F.lit(float(p.max_tokens)))
    return p.alpha * F.coalesce(cos, F.lit(0.0)) + p.beta * cover + p.gamma * brevity
