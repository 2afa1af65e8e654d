"""License scans: base phrases, and an exact set-similarity join of text blocks with templates (native).

Words are runs of letters, digits and characters beyond ASCII, in lower case. A block is a line of the text, or a
window: as many neighbouring words as the template has, anywhere in the text, so that a statement wrapped over lines is
met whole. A block matches a template when it holds at least ``threshold`` of the template's distinct words. The join is
exact:

* template words are ordered by how many documents hold them, rarest first, counted over the whole corpus;
* prefix filter: a match must hold one of the first ``m - need + 1`` words of the template, so only blocks with such a
  word are looked at;
* length filter: a match has at least ``need`` distinct words;
* positional filter: from the first shared word on, both sides must still have ``need`` words of the order; a window lies
  within a template's length of such a word;
* what is left is verified by intersecting the sets.

The templates are a fixed list, so its side of the join has a fixed size and is broadcast.

Defined results: a null or empty text has no words, places or labels and score 0; repeated rows are each scanned; a
block that matches several templates gets all their labels; no rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize

# fixed values: base phrases and their labels
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# fixed values: label and statement
TEMPLATES = (
    ("mit", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl", "gnu general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "mozilla public license version 2"),
)
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # of a text before or after lower()
#: lower() keeps word boundaries, and no letter of the phrases is the lower form of a letter beyond ASCII ("k" is not among them).


def _words(low: Column) -> Column:
    return F.array_remove(F.split(low, GAP), "")


def _places(words: Column, low: Column) -> Column:
    """(start, label) of every place of a base phrase."""
    none = F.array().cast("array<struct<start:bigint,label:string>>")

    def of(parts: list[str], label: str) -> Column:
        last = F.size(words) - len(parts)

        def here(i: Column) -> Column:
            cond = F.lit(True)
            for k, w in enumerate(parts):
                cond = cond & (F.get(words, i + k) == w)
            return cond

        every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        at = F.transform(F.filter(every, here), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
        return F.when(low.rlike(GAP.join(parts)), at).otherwise(none)

    found = [of(phrase.split(" "), label) for phrase, label in PHRASES]
    return F.concat(*found)


def _templates(threshold: float) -> list[tuple[int, str, list[str], int]]:
    out = []
    for i, (label, text) in enumerate(TEMPLATES):
        words = list(dict.fromkeys(text.split(" ")))
        out.append((i, label, words, ceil(threshold * len(words) - 1e-9)))
    return out


def matches(docs: DataFrame, order: dict[str, int], threshold: float, row: str = "_row") -> DataFrame:
    """(row, block, template, label, containment) of every block that meets a template; ``docs`` has ``row`` and ``_low``.

    A window's block is null; of the windows around one word only the best is given.
    """
    spark = docs.sparkSession
    rank = lambda w: (order.get(w, 0), w)
    places = {w: i for i, w in enumerate(sorted({w for t in _templates(threshold) for w in t[2]}, key=rank))}
    side = []
    for i, label, words, need in _templates(threshold):
        ordered = sorted(words, key=places.get)
        for at, w in enumerate(ordered[: len(words) - need + 1]):
            side.append((i, label, w, at, len(words), need, len(TEMPLATES[i][1].split(" ")), ordered))
    index = F.broadcast(
        spark.createDataFrame(side, "template int, label string, word string, at int, m int, need int, reach int, ordered array<string>")
    )
    heads = sorted({s[2] for s in side})
    edge = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
    has_head = f"(?<!{edge})({'|'.join(heads)})(?!{edge})"
    known = F.array(*[F.lit(w) for w in places])  # in global order; words outside it cannot match
    low = F.col("_low")
    numbered = F.transform(F.split(low, "\n"), lambda x, i: F.struct(i.alias("block"), x.alias("line")))
    near = F.transform(F.filter(numbered, lambda x: x["line"].rlike(has_head)), lambda x: F.struct(x["block"].alias("block"), F.array_distinct(_words(x["line"])).alias("set")))
    placed = F.transform(_words(low), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    read = docs.where(low.rlike(has_head)).select(row, near.alias("_lines"), F.filter(placed, lambda x: x["w"].isin(*places)).alias("_seq"))
    read = materialize(read, "license-near")  # of the texts that hold a head, only what the filters look at
    lines = (
        read.select(row, F.explode("_lines").alias("_x"))
        .select(row, F.col("_x")["block"].alias("block"), F.col("_x")["set"].alias("_set"))
        .select(row, "block", F.size("_set").alias("_n"), F.array_intersect(known, "_set").alias("_own"))
        .select(row, "block", "_n", "_own", F.posexplode("_own").alias("_pos", "word"))
    )
    met = lines.join(index, "word").where((F.col("_n") >= F.col("need")) & (F.least(F.col("m") - F.col("at"), F.size("_own") - F.col("_pos")) >= F.col("need")))
    first = F.get(F.array_intersect("ordered", "_own"), F.lit(0)) == F.col("word")  # one row for each block and template
    met = met.where(first).withColumn("_same", F.size(F.array_intersect("ordered", "_own")))
    # words of the templates around each head, then the windows that start at one of them
    around = read.select(row, "_seq", F.explode("_seq").alias("_x")).where(F.col("_x")["w"].isin(*heads)).join(index, F.col("_x")["w"] == F.col("word"))
    held = lambda of: F.size(F.array_intersect("ordered", F.transform(of, lambda y: y["w"])))
    around = around.withColumn("_by", F.filter("_seq", lambda y: F.abs(y["i"] - F.col("_x")["i"]) < F.col("reach"))).where(held(F.col("_by")) >= F.col("need"))
    window = lambda x: F.filter("_by", lambda y: (y["i"] >= x["i"]) & (y["i"] < x["i"] + F.col("reach")))
    around = around.withColumns({"_same": F.array_max(F.transform("_by", lambda x: held(window(x)))), "block": F.lit(None).cast("int")})
    both = [x.where("_same >= need").select(row, "block", "template", "label", (F.col("_same") / F.col("m")).alias("containment")) for x in (met, around)]
    return both[0].unionByName(both[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, places, found): base places as (start, label), and the template matches' (label, containment)."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t in TEMPLATES for w in t.split(" ")})])
    # ids need not be unique: the row's own text position stands for it
    rows = docs.select(F.col(id_col).alias("doc_id"), low.alias("_low"))
    read = rows.withColumn("_w", _words(F.col("_low")))
    key = F.xxhash64("doc_id", "_low")
    read = materialize(
        read.select(
            "doc_id", key.alias("_row"), F.size("_w").cast("long").alias("n_words"),
            _places(F.col("_w"), F.col("_low")).alias("places"), F.array_intersect(vocabulary, "_w").alias("_v"),
        ),
        "license-read",
    )
    counted = read.select(F.explode("_v").alias("w")).groupBy("w").count().collect()  # as many rows as template words
    order = {r["w"]: r["count"] for r in counted}
    found = matches(rows.withColumn("_row", key), order, threshold)
    # equal rows have equal texts, and so equal matches: one of each label is kept
    found = found.groupBy("_row", "label").agg(F.max("containment").alias("containment"))
    found = found.groupBy("_row").agg(F.collect_list(F.struct("label", "containment")).alias("found"))  # as many as labels
    return read.join(found, "_row", "left").select("doc_id", "n_words", "places", F.coalesce("found", F.array()).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of :func:`scan`'s result."""
    start = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda m: m["containment"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("found", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
