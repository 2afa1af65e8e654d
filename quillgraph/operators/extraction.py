"""Replies of an extracting model: tolerant reading, validation, and retries of what cannot be read, in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import expr as E
from quillgraph.sources.state import written

ENTITY = "struct<name string, type string, description string, source_block_refs array<string>>"
RELATION = "struct<source string, target string, relation_type string, description string, strength string, keywords array<string>, source_block_refs array<string>>"
REPLY = f"struct<entities array<{ENTITY}>, relations array<{RELATION}>>"
#: A whole string of JSON, or one that the text's end cuts off.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)'


def _open(text: Column) -> Column:
    """(in_string, escaped, closers): what is open at the end of ``text``. One fold over its characters; closers come in
    the order in which they are due."""

    def step(acc: Column, c: Column) -> Column:
        quote, plain = c == '"', ~acc["in_string"]
        return F.struct(
            F.when(acc["escaped"], acc["in_string"]).when(quote, plain).otherwise(acc["in_string"]).alias("in_string"),
            (acc["in_string"] & ~acc["escaped"] & (c == "\\")).alias("escaped"),
            F.when(plain & (c == "{"), F.concat(F.lit("}"), acc["closers"]))
            .when(plain & (c == "["), F.concat(F.lit("]"), acc["closers"]))
            .when(plain & c.isin("}", "]"), F.substr(acc["closers"], F.lit(2)))
            .otherwise(acc["closers"])
            .alias("closers"),
        )

    start = F.struct(F.lit(False).alias("in_string"), F.lit(False).alias("escaped"), F.lit("").alias("closers"))
    return F.aggregate(F.split(text, ""), start, step)


def repaired(text: Column) -> Column:
    """``text`` as JSON, where a model wrote nearly that: what stands before the first brace and a code fence go, a string,
    list or object that the end cuts off is closed (a key without its value goes), and commas before a closing mark go.
    What stands after the first whole object goes when the result is read. A null text stays null."""
    body = F.regexp_replace(text, r"(?s)^[^{]*", "")
    body = F.regexp_replace(body, r"(?s)\s*```\s*$", "")
    state = _open(body)
    # bound to a name, so that the fold runs once
    ends = F.transform(F.array(F.struct(body.alias("b"), state.alias("s"))), lambda x: F.struct(_closed(x["b"], x["s"]).alias("b"), x["s"]["closers"].alias("c")))
    whole = F.get(F.transform(ends, lambda x: F.concat(x["b"], x["c"])), F.lit(0))
    # a string is matched as a whole, so commas inside it stay
    return F.regexp_replace(whole, rf"({_STRING})|,(?=\s*[\]}}])", "$1")


def _closed(body: Column, state: Column) -> Column:
    cut = F.when(state["escaped"], F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    cut = F.when(state["in_string"], F.concat(cut, F.lit('"'))).otherwise(cut)
    dangling = rf'(?s)(?<=[{{,])\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?\s*$'
    in_object = state["closers"].startswith("}")
    cut = F.when(in_object, F.regexp_replace(cut, dangling, "")).otherwise(cut)
    return F.regexp_replace(cut, r"[,:\s]+$", "")


def parsed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``replies`` with entities, relations and readable.

    Entities keep a name; their type is one of the known ones and their description '' at least. Relations keep source and
    target; their strength is 1 to 10, 5 where it is no number. Items that break these rules go one by one. A reply that
    holds no object even after mending is not readable, and has no items; a blank one is readable and empty.
    """
    r = F.from_json(repaired(F.col(reply)), REPLY, {"allowUnquotedControlChars": "true", "allowSingleQuotes": "true"})
    out = replies.withColumn("_r", r)
    blank = F.trim(F.coalesce(F.col(reply), F.lit(""))) == ""
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    none = lambda t: F.array().cast(t)
    entities = F.transform(
        F.filter(F.coalesce("_r.entities", none(f"array<{ENTITY}>")), lambda e: there(e["name"])),
        lambda e: F.struct(F.trim(e["name"]).alias("name"), E.entity_type(F.coalesce(e["type"], F.lit(""))).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description"), F.coalesce(e["source_block_refs"], none("array<string>")).alias("refs")),
    )
    relations = F.transform(
        F.filter(F.coalesce("_r.relations", none(f"array<{RELATION}>")), lambda x: there(x["source"]) & there(x["target"])),
        lambda x: F.struct(F.trim(x["source"]).alias("source"), F.trim(x["target"]).alias("target"), F.coalesce(x["relation_type"], F.lit("")).alias("relation_type"), E.strength(x["strength"]).alias("strength"), F.coalesce(x["keywords"], none("array<string>")).alias("keywords")),
    )
    known = F.col("_r.entities").isNotNull() | F.col("_r.relations").isNotNull()
    return out.withColumns({"entities": entities, "relations": relations, "readable": blank | F.coalesce(known, F.lit(False))}).drop("_r")


def extracted(prompts: DataFrame, ask: Callable[[DataFrame, int], DataFrame], retries: int = 2, key: str = "block_id") -> DataFrame:
    """(key, reply, entities, relations, readable, attempt): each prompt asked once and, while its reply is not readable, up
    to ``retries`` times more, all unreadable ones together. ``ask`` gives (key, reply) for prompts and an attempt."""
    left, done = prompts, None
    for attempt in range(retries + 1):
        got = written(parsed(ask(left, attempt)).withColumn("attempt", F.lit(attempt)), "extracted")
        last = attempt == retries
        part = got if last else got.where("readable")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        left = prompts.join(got.where("not readable").select(key), key, "left_semi")
    return done
