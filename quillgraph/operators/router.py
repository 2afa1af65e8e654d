"""Rule-based routing of questions and the small text rules around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import RouterParams
from quillgraph.functions.expr import any_of, first_match

# fixed values: what sends a question to each mode
NAVIGATION = (
    "分别",
    "各自",
    "respectively",
    "和.*是什么",
    "admission.*fee",
    "tuition.*scholarship",
    "requirements?.*and.*(fee|tuition|scholarship|deadline|cost)",
)
REASONING = (
    "哪些",
    "有谁",
    "有什么老师",
    "有哪些老师",
    "哪位老师",
    "哪些老师",
    "哪些教授",
    "which.*professors?",
    "who.*research",
    "做.*研究",
    "研究方向",
)
COMPARISON = (
    r"\bdifferences?\s+(in|between|of)\b",
    r"\bhow\s+do(es)?\s+.+\s+(compare|differ|relate)\b",
    r"\bcompare(d|s)?\s+to\b",
    r"\bcontrast(s|ed)?\s+(with|to)\b",
    r"\bdiffer\s+between\b",
    r"\bvs\.?\b",
    r"\bversus\b",
    r"\bhow\s+does\s+.+\s+align\s+with\b",
)
SHARED_RESEARCHER = (
    r"\b(two|both|which)\s+researchers?\s+.*\b(share|shared|same|common|co-?author(ed)?|collaborate(d)?)\b",
    r"\bco-?author(ed)?\s+(a\s+paper|paper)\b",
    r"\bjoint\s+publication\b",
    r"\bcommon\s+research\s+(topic|interest|area)\b",
    r"\bshare(d)?\s+(a\s+)?research\s+(interest|topic|area)\b",
)
PERSON = (
    r"prof\.?\s+\w+",
    r"dr\.?\s+\w+",
    r"professor\s+\w+",
)
CROSS_PAGE = (
    "differ", "difference", "compare", "comparison", " vs ", " vs. ", "versus", "between", "respectively", "分别", "各自",
    "which professors", "which researchers", "who are the", "list all", "all the", "research areas",
)
MODES = ("mode_a", "mode_b", "mode_c", "mode_d")
R = RouterParams()


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return any_of([text.rlike(p) for p in patterns])


def route(queries: DataFrame, text: str = "text", p: RouterParams = R) -> DataFrame:
    """Adds mode, confidence, alt_mode and rule. A list question goes to reasoning; one that names a person as well is
    mixed, and no single-mode rule decides it, not even where a navigation pattern fits."""
    q = F.lower(F.trim(F.col(text)))
    mixed = _any(q, REASONING) & _any(q, PERSON)
    rules = [
        (_any(q, REASONING) & ~mixed, ("mode_c", 1.0, None, "heuristic")),
        (_any(q, NAVIGATION) & ~mixed, ("mode_b", 1.0, None, "heuristic")),
        (_any(q, COMPARISON), ("mode_b", 0.55, "mode_a", "comparison")),
        (_any(q, SHARED_RESEARCHER), ("mode_b", 0.55, "mode_c", "shared")),
    ]
    pick = lambda i, default: first_match([(c, v[i] if v[i] is not None else F.lit(None).cast("string")) for c, v in rules], default)
    alt = F.lit(None).cast("string") if p.disable_hybrid else pick(2, F.lit(None).cast("string"))
    return queries.withColumns({
        "mode": pick(0, F.lit("mode_a")), "confidence": pick(1, F.lit(0.5)).cast("double"), "alt_mode": alt,
        "rule": pick(3, F.lit("default")),
    })


def validated(decisions: DataFrame, allowed: tuple[str, ...] = MODES[:3], p: RouterParams = R) -> DataFrame:
    """A model's raw (mode, confidence, alt_mode): confidence cut to 0..1, alternatives checked or derived, unknown modes to A."""
    mode = F.when(F.col("mode").isin(*allowed), F.col("mode")).otherwise("mode_a")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(p.default_confidence))))
    given = F.when(F.col("alt_mode").isin(*allowed) & (F.col("alt_mode") != mode), F.col("alt_mode"))
    derived = F.when((conf >= p.auto_alt_floor) & (conf < p.hybrid_threshold), F.when(mode == "mode_b", "mode_c").otherwise("mode_b"))
    alt = F.lit(None).cast("string") if p.disable_hybrid else F.coalesce(given, derived)
    return decisions.withColumns({"mode": mode, "confidence": conf, "alt_mode": alt})


def coerced(decisions: DataFrame, allowed: tuple[str, ...], text: str = "text") -> DataFrame:
    """Decisions outside ``allowed`` go to B where the question crosses pages and B is allowed, else to the first allowed."""
    q = F.lower(F.col(text))
    crosses = any_of([F.contains(q, F.lit(c)) for c in CROSS_PAGE])
    other = F.when(crosses & F.lit("mode_b" in allowed), "mode_b").otherwise(allowed[0])
    return decisions.withColumn("mode", F.when(F.col("mode").isin(*allowed), F.col("mode")).otherwise(other))


def is_hybrid(forced: Column, mode: Column, alt: Column, confidence: Column, p: RouterParams = R) -> Column:
    gate = forced.isNull() & alt.isNotNull() & (confidence < p.hybrid_threshold) & (mode != alt)
    return F.coalesce(forced == "hybrid", F.lit(False)) | F.coalesce(gate, F.lit(False))


def skip_rewrite(confidence: Column, gate: float) -> Column:
    return F.lit(gate > 0) & F.coalesce(confidence >= gate, F.lit(False))


def expand_acronyms(queries: DataFrame, aliases: DataFrame, text: str = "text", query_id: str = "query_id") -> DataFrame:
    """Adds ``expanded``: the query and, for variants in it whose full name is not, `` (V = C; ..)``.

    Questions meet the aliases (variant, canonical) by the first word of the variant, whatever the size of either side;
    variants up to three characters keep their case.
    """
    word = "[\\p{L}\\p{N}_]+"
    asked = queries.withColumn("_w", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0)))))
    hit = asked.join(aliases.withColumn("_w", F.regexp_extract(F.lower("variant"), word, 0)), "_w").drop("_w")
    quoted = F.regexp_replace("variant", "([\\\\.\\[\\]{}()*+?^$|/-])", "\\\\$1")
    pattern = F.concat(F.when(F.length("variant") <= 3, F.lit("")).otherwise(F.lit("(?i)")), F.lit("\\b"), quoted, F.lit("\\b"))
    found = hit.where(F.regexp_like(text, pattern) & ~F.contains(F.lower(text), F.lower("canonical")))
    best = found.groupBy(query_id, "canonical").agg(F.min("variant").alias("variant"))
    listed = best.groupBy(query_id).agg(F.array_sort(F.collect_list(F.concat_ws(" = ", "variant", "canonical"))).alias("l"))
    out = queries.join(listed, query_id, "left")
    return out.withColumn("expanded", F.when(F.col("l").isNull(), F.col(text)).otherwise(F.concat(F.col(text), F.lit(" ("), F.array_join("l", "; "), F.lit(")")))).drop("l")


def history(turns: DataFrame, last: int = 3) -> DataFrame:
    """(conv_id, n, user_text, assistant_text): the last pairs of a user turn and the assistant turn right after it.

    An empty assistant turn drops the waiting user turn. n counts back from the latest pair.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    talk = turns.where("role in ('user', 'assistant')")
    rows = talk.withColumns({"prev_role": F.lag("role").over(w), "prev_text": F.lag("text").over(w)})
    pairs = rows.where("role = 'assistant' and prev_role = 'user' and trim(text) <> ''")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return pairs.withColumn("n", back).where(F.col("n") <= last).select("conv_id", "n", F.col("prev_text").alias("user_text"), F.col("text").alias("assistant_text"))


def suggestions(rows: DataFrame, least: int = 8, most: int = 120, keep: int = 3) -> DataFrame:
    """(query_id, n, suggestion) from (query_id, query, position, suggestion): trimmed, of fair length, new, unique by case."""
    s = F.trim(F.regexp_replace(F.trim("suggestion"), "^[\"']+|[\"']+$", ""))
    ok = rows.withColumn("suggestion", s).where(F.length("suggestion").between(least, most) & (F.lower("suggestion") != F.lower(F.trim("query"))))
    first = ok.groupBy("query_id", F.lower("suggestion").alias("_k")).agg(F.min(F.struct("position", "suggestion")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m.position", "m.suggestion")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).select("query_id", "n", F.col("m.suggestion").alias("suggestion"))


def contextual(raw: Column, rewritten: Column) -> Column:
    """The rewritten question, or the raw one if the rewrite is empty, too long or the same."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(rewritten), "(?i)^(rewritten|standalone)( question)?:\\s*", ""), "^[\"']+|[\"']+$", ""))
    return F.when(F.coalesce((clean == "") | (F.length(clean) > 300) | (clean == raw), F.lit(True)), raw).otherwise(clean)


def slug(question: Column, words: int = 6) -> Column:
    parts = F.filter(F.split(F.lower(question), "[^a-z0-9]+"), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, words), "_")
