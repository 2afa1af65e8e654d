"""HTML pages to tables: cleaning, links, and the block tree, all over one table of nodes.

A pass over a page numbers its nodes, so that a node's subtree is an interval (pre to post); it repairs what pages commonly
leave open (paragraphs, list items, cells), keeps no tree and does not recurse. Texts, blocks, paths and headings are then
joins, windows and groups over those rows. Rows of one page meet by its number; no page is larger than what one task parsed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillgraph.config import BlockParams
from quillgraph.sources.state import written

# fixed values
REMOVED = ("script", "style", "noscript", "svg", "iframe", "object", "embed", "applet", "link", "meta")
KEPT_ATTRIBUTES = ("href", "src", "alt", "id", "class")
WHOLE = ("table", "thead", "tbody", "tr", "ul", "ol", "dl", "pre", "code")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: An opening tag of the first kind closes an open element of the second.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
} | {t: {"p"} for t in ("div", "article", "section", "header", "footer", "nav", "ul", "ol", "table", "form", "main", "aside", "pre", "blockquote", *HEADINGS)}
#: Elements whose text is asked for by itself.
NAMED = ("title", "a", *HEADINGS)
#: A batch of pages is read in parts of so many pages, and handed on in parts of about this many nodes.
PAGES, NODES = 64, 10_000
_CJK = re.compile("[\u4e00-\u9fff\u3400-\u4dbf]")

NODE_SCHEMA = (
    "page long, url string, pre int, post int, parent int, depth int, tag string, ident string, href string, text string, "
    "hidden boolean, words int, parent_words int, sealed int, level int, inside array<int>, trail array<int>"
)


class _Outline(HTMLParser):
    """The nodes of one page in document order, as columns; the root is node 0."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.post: list[int] = []
        self.ident: list[str | None] = []
        self.href: list[str | None] = []
        self.text: list[str | None] = []
        self.hidden: list[bool] = []
        self.words: list[int] = []
        self.inside: list[list[int] | None] = []
        self.trail: list[list[int] | None] = []
        self.open: list[int] = []
        self.named: list[int] = []
        self.count: Counter[str] = Counter()
        self.seen = 0
        self._push("#root", {})

    def _add(self, tag: str | None, text: str | None, attrs: dict[str, str]) -> int:
        at, up = len(self.tag), self.open[-1] if self.open else -1
        self.tag.append(tag)
        self.text.append(text)
        self.parent.append(up)
        self.depth.append(len(self.open))
        self.post.append(at)
        self.ident.append(attrs.get("id") or None)
        self.href.append(attrs.get("href", "").strip() if tag == "a" else None)
        self.hidden.append((up >= 0 and self.hidden[up]) or tag in REMOVED)
        if text is not None and not self.hidden[at]:
            self.seen += len(_CJK.findall(text)) + len(text.split())
        self.words.append(self.seen)
        self.inside.append(list(self.named) if text is not None else None)
        self.trail.append([*self.open[1:], at] if tag in HEADINGS else None)
        return at

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        self.open.append(self._add(tag, None, attrs))
        self.count[tag] += 1
        if tag in NAMED:
            self.named.append(self.open[-1])

    def _pop(self) -> str:
        at = self.open.pop()
        tag = self.tag[at] or ""
        self.count[tag] -= 1
        if tag in NAMED:
            self.named.pop()
        self.post[at] = len(self.tag) - 1
        self.words[at] = self.seen - self.words[at]
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while len(self.open) > 1 and self.tag[self.open[-1]] in CLOSES.get(tag, ()):
            self._pop()
        kept = {k: v or "" for k, v in attrs}
        if tag in VOID:
            self.handle_startendtag(tag, attrs)
        else:
            self._push(tag, kept)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.words[self._add(tag, None, {k: v or "" for k, v in attrs})] = 0

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag] and tag != "#root":
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add(None, data.strip(), {})

    def columns(self) -> dict[str, list]:
        """All columns, once the page is read: words within a node, words within its parent, elements of the kinds that are
        never split above it, and its level below the body (negative above; null elsewhere)."""
        while self.open:
            self._pop()
        n = range(len(self.tag))
        body = next((i for i in n if self.tag[i] == "body" and not self.hidden[i]), 0)
        sealed, above = [0] * len(n), {body}
        for i in n[1:]:
            up = self.parent[i]
            sealed[i] = sealed[up] + (self.tag[up] in WHOLE)
        at = self.parent[body]
        while at > 0:
            above.add(at)
            at = self.parent[at]
        chain = [body <= i <= self.post[body] or i in above for i in n]
        return {
            "pre": list(n), "post": self.post, "parent": self.parent, "depth": self.depth, "tag": self.tag, "ident": self.ident, "href": self.href,
            "text": self.text, "hidden": self.hidden, "words": self.words, "parent_words": [self.words[p] if p >= 0 else 0 for p in self.parent],
            "sealed": [x - sealed[body] for x in sealed], "level": [self.depth[i] - self.depth[body] if chain[i] else None for i in n],
            "inside": self.inside, "trail": self.trail,
        }


def _outline(html: str) -> dict[str, list]:
    o = _Outline()
    o.feed(html)
    o.close()
    return o.columns()


def nodes(pages: DataFrame) -> DataFrame:
    """Elements and texts of every page (url, html), by :data:`NODE_SCHEMA`; texts have no tag, blank ones no row.

    ``page`` numbers the rows of ``pages``, so repeated pages stay apart. Null urls and pages count as empty ones. What the
    cleaning removes is marked hidden. ``inside`` lists the titles, headings and anchors that a text lies in, ``trail`` the
    elements that a heading lies in. The words of a text are counted up to it, those of an element within it.
    """
    schema = to_arrow_schema(StructType.fromDDL(NODE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {c: [] for c in schema.names}
        for part in (batch.slice(at, PAGES) for batch in batches for at in range(0, batch.num_rows, PAGES)):
            for page, url, html in zip(*[part.column(c).to_pylist() for c in ("page", "url", "html")], strict=True):
                cols = _outline(html or "")
                n = len(cols["pre"])
                cols |= {"page": [page] * n, "url": [url or ""] * n, "href": [h if not h else _joined(url or "", h) for h in cols["href"]]}
                for c in schema.names:
                    rows[c].extend(cols[c])
                if len(rows["pre"]) >= NODES:
                    yield pa.RecordBatch.from_pydict(rows, schema)
                    rows = {c: [] for c in schema.names}
        yield pa.RecordBatch.from_pydict(rows, schema)

    return pages.select(F.monotonically_increasing_id().alias("page"), "url", "html").mapInArrow(run, NODE_SCHEMA)


def _joined(url: str, href: str) -> str | None:
    """The target of an anchor without fragment and query; none for those that lead to no page."""
    if href.startswith("#") or href.lower().startswith(("mailto:", "javascript:")):
        return None
    try:
        return re.sub("[#?].*$", "", urljoin(url, href))
    except ValueError:  # a broken host
        return None


def _in_order(order: str, text: str = "text", by: str = " ") -> Column:
    """The texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), by)


def named_texts(n: DataFrame) -> DataFrame:
    """(page, pre, text): the text of every title, heading and anchor that has any."""
    rows = n.where("tag is null").select("page", F.col("pre").alias("at"), "text", F.explode("inside").alias("pre"))
    return rows.groupBy("page", "pre").agg(_in_order("at").alias("text"))


def segments(n: DataFrame) -> DataFrame:
    """Elements that are seen, with ``step`` of their path and ``child_index`` among the elements of their parent.

    A step is tag#id where the id is one alone among its siblings, tag#id[n] where it is not, tag[n] without an id; n counts
    siblings of the tag.
    """
    rows = n.where("tag is not null and not hidden").drop("text", "inside", "href").repartition("page")
    alike = F.row_number().over(Window.partitionBy("page", "parent", "tag").orderBy("pre")) - 1
    twins = F.count("ident").over(Window.partitionBy("page", "parent", "ident"))
    index = F.row_number().over(Window.partitionBy("page", "parent").orderBy("pre")) - 1
    number = F.concat(F.lit("["), alike.cast("string"), F.lit("]"))
    named = F.concat("tag", F.lit("#"), "ident")
    step = F.when(F.col("ident").isNull(), F.concat("tag", number)).when(twins == 1, named).otherwise(F.concat(named, number))
    return rows.select("*", F.when(F.col("pre") == 0, "body[0]").otherwise(step).alias("step"), index.alias("child_index"))


def block_tree(pages: DataFrame, p: BlockParams = BlockParams()) -> DataFrame:
    """Leaf blocks of every page (url, html).

    An element is split if it has more than ``max_words`` words and is no table, list or code; what is met unsplit and has
    ``min_words`` words is a block, and so is an element whose split gave none. As a split element always gives a block,
    that is one that has neither a split child nor one that is a block. Blocks never overlap, so a text belongs to the last
    block that begins before it. A block's headings are all that begin before its end: those of an earlier branch level by
    level, branches in order, each text once; without one, the page's title. Empty pages have no block.
    """
    n = written(nodes(pages), "html-nodes")  # parsed once
    e = segments(n)
    whole = F.col("tag").isin(*WHOLE)
    reached = e.where((F.col("level") <= 0) | ((F.col("sealed") == 0) & (F.col("parent_words") > p.max_words) & (F.col("level") > 0)))
    reached = written(reached.withColumn("split", ~whole & (F.col("words") > p.max_words)), "html-reached")
    met = reached.where("level >= 0")
    gives = met.where(F.col("split") | (F.col("words") >= p.min_words)).where("level > 0").select("page", F.col("parent").alias("pre")).distinct()
    leaf = met.where(~F.col("split") & (F.col("words") >= p.min_words) & (F.col("words") > 0))
    last = met.where("split").join(gives, ["page", "pre"], "left_anti")
    block = leaf.unionByName(last.select(*leaf.columns))
    # the elements that lead to a block: those above the body, and split ones
    over = reached.where("(split or level < 0) and pre > 0").select("page", F.col("pre").alias("a"), F.col("post").alias("z"), F.col("step").alias("over"))
    root = reached.where("split and pre = 0 and level = 0").select("page", F.lit(True).alias("rooted"))
    ways = block.join(over, (block["page"] == over["page"]) & (F.col("a") < F.col("pre")) & (F.col("pre") <= F.col("z"))).select(block["page"], "pre", F.struct("a", "over").alias("way"))
    ways = ways.groupBy("page", "pre").agg(F.array_sort(F.collect_list("way")).alias("ways"))
    steps = F.coalesce(F.transform("ways", lambda w: w["over"]), F.array().cast("array<string>"))
    steps = F.when(F.col("rooted") & (F.col("pre") > 0), F.concat(F.array(F.lit("body[0]")), steps)).otherwise(steps)
    block = block.join(ways, ["page", "pre"], "left").join(root, "page", "left").withColumn("above", F.array_join(steps, ">"))
    path = F.concat_ws(">", F.nullif("above", F.lit("")), "step")
    ident = lambda way: F.md5(F.concat("url", F.lit("|"), way))
    up = F.concat(F.coalesce(F.transform("ways", lambda w: w["a"]), F.array().cast("array<int>")), F.array("pre"))
    block = block.select(
        "page", "pre", "post", "url", ident(path).alias("block_id"), path.alias("html_tag_path"), F.col("words").alias("token_count"), F.col("level").alias("depth"),
        F.when(F.col("level") > 0, ident(F.col("above"))).alias("parent_block_id"), F.when(F.col("level") > 0, F.col("child_index")).otherwise(0).alias("child_index"), up.alias("up"),
    )
    block = written(block, "html-blocks")
    texts = n.where("tag is null and not hidden").select("page", "pre", "text", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("end"))
    starts = block.select("page", "pre", F.lit(None).cast("string").alias("text"), F.col("pre").alias("at"), F.col("post").alias("end"))
    before = Window.partitionBy("page").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    owned = texts.unionByName(starts).select("page", "pre", "text", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("at", "end")])
    content = owned.where("text is not null and pre <= end").groupBy("page", F.col("at")).agg(_in_order("pre").alias("content")).withColumnRenamed("at", "pre")
    said = named_texts(n.where("not hidden"))
    title = n.where("tag = 'title' and not hidden").groupBy("page").agg(F.min("pre").alias("pre")).join(said, ["page", "pre"]).select("page", F.col("text").alias("title"))
    heading = n.where(F.col("tag").isin(*HEADINGS) & ~F.col("hidden")).select("page", "pre", "depth", "trail").join(said, ["page", "pre"])
    heading = heading.select("page", F.col("pre").alias("h"), F.col("depth").alias("deep"), "trail", F.col("text").alias("said"))
    shared = F.size(F.array_intersect("up", "trail"))
    branch = F.coalesce(F.get("trail", shared), F.col("h"))  # where the heading's way leaves the block's
    led = block.join(heading, "page").where("h <= post").select("page", "pre", F.struct(branch.alias("branch"), F.col("deep"), F.col("h"), F.col("said")).alias("x"))
    led = led.groupBy("page", "pre").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"])), " > ").alias("led"))
    out = block.join(content, ["page", "pre"]).join(led, ["page", "pre"], "left").join(title, "page", "left")
    return out.select(
        "block_id", "content", "html_tag_path", F.coalesce("led", "title", F.lit("")).alias("heading_context"), "token_count", "depth", "parent_block_id", "child_index", "url",
    )


def clean_text(pages: DataFrame) -> DataFrame:
    """(url, text): visible text of every page; one without any has an empty text."""
    n = nodes(pages).where("not hidden and (tag is null or pre = 0)").select("page", "url", "pre", "text")
    text = n.groupBy("page", "url").agg(_in_order("pre").alias("text"))
    return text.select("url", F.regexp_replace("text", "[ \\t]+", " ").alias("text"))


def dom_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url, anchor_text, ordinal): resolved anchors, first-seen unique, without fragment and query."""
    n = written(nodes(pages).where("href <> '' or (tag is null and array_size(inside) > 0)"), "html-anchors")
    first = n.where("tag = 'a'").groupBy("page", "url", "href").agg(F.min("pre").alias("pre"))
    rows = first.join(named_texts(n), ["page", "pre"], "left")
    ordinal = F.row_number().over(Window.partitionBy("page").orderBy("pre")) - 1
    return rows.select(F.col("url").alias("from_url"), F.col("href").alias("to_url"), F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("anchor_text"), ordinal.alias("ordinal"))
