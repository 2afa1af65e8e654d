"""The engine's verbs over a set of tables. Each returns a DataFrame; nothing is collected but what a verb looks up."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillgraph.config import Settings
from quillgraph.operators import bm25, graph, modes, rank, router, search
from quillgraph.sources.state import written

#: The tables that each mode reads, and the modes of a hybrid that is asked for.
NEEDS = {
    "mode_a": {"blocks", "vectors"},
    "mode_b": {"blocks", "vectors", "pages", "links"},
    "mode_c": {"edges", "mentions", "entities"},
    "mode_d": {"edges", "mentions", "entities"},
}
HYBRID = ("mode_a", "mode_b", "mode_c")


class Forbidden(RuntimeError):
    """A table that the session may not read."""


@dataclass
class Engine:
    """``tables`` has blocks, vectors, nodes, edges, pages, links, mentions, entities as far as the verbs in use need them;
    ``index`` is the stored sparse index of the blocks, if there is one, or a function that gives it to the mode that reads it.
    Mentions without url and tokens take those of their blocks."""

    tables: dict[str, DataFrame]
    settings: Settings = Settings()
    forbidden: frozenset[str] = frozenset()
    index: bm25.Index | Callable[[], bm25.Index] | None = None

    def table(self, name: str) -> DataFrame:
        if name in self.forbidden:
            raise Forbidden(name)
        return self.tables[name]

    def routed(self, questions: DataFrame, mode: str | None = None) -> DataFrame:
        """Routed questions (query_id, text, qvec): a mode that is asked for must exist."""
        if mode is not None and mode not in (*router.MODES, "hybrid"):
            raise ValueError(f"unknown mode {mode!r}")
        routed = router.route(questions, p=self.settings.router)
        if mode is not None:
            routed = routed.withColumn("mode", F.lit(mode))
        return routed

    def query(self, questions: DataFrame, mode: str | None = None) -> DataFrame:
        """(query_id, id, score, from_modes, rank) of every question: routed, run in its modes, scaled by mode and merged.

        ``mode="hybrid"`` asks for all of A, B and C; the router's own hybrid for its mode and the alternative. Each mode
        runs once, over the questions it is asked for. A mode that is asked for by name must have its tables; a question
        that the router sends to one without them runs in mode A, which ``from_modes`` says.
        """
        return self._steps(questions, mode)["merge"]

    def asked(self, questions: DataFrame, mode: str | None = None) -> DataFrame:
        """(query_id, text, qvec, mode): each question once for each mode that it is run in."""
        if mode is not None:
            if mode not in (*router.MODES, "hybrid"):
                raise ValueError(f"unknown mode {mode!r}")
            wanted = HYBRID if mode == "hybrid" else (mode,)
            lacking = {m: sorted(NEEDS[m] - self.tables.keys()) for m in wanted if not NEEDS[m] <= self.tables.keys()}
            if lacking:
                raise KeyError(f"tables missing for {lacking}")
            modes_of = F.array(*[F.lit(m) for m in wanted])
            return self.routed(questions, mode).select("query_id", "text", "qvec", F.explode(modes_of).alias("mode"))
        rows = self.routed(questions)
        both = router.is_hybrid(F.lit(None).cast("string"), F.col("mode"), F.col("alt_mode"), F.col("confidence"), self.settings.router)
        listed = F.array_compact(F.array(F.col("mode"), F.when(both, F.col("alt_mode"))))
        rows = rows.select("query_id", "text", "qvec", F.explode(listed).alias("mode"))
        ready = [m for m in NEEDS if NEEDS[m] <= self.tables.keys()]
        return rows.withColumn("mode", F.when(F.col("mode").isin(*ready), F.col("mode")).otherwise("mode_a")).dropDuplicates(["query_id", "mode"])

    def _steps(self, questions: DataFrame, mode: str | None, watch=lambda name, df: df) -> dict[str, DataFrame]:
        """The stages of :meth:`query` by name, in order; ``watch`` may look at each."""
        asked = watch("routing", self.asked(questions, mode))
        wanted = [m for m in NEEDS if NEEDS[m] <= self.tables.keys()] if mode is None else HYBRID if mode == "hybrid" else (mode,)
        runs = {"mode_a": self.direct, "mode_b": self.navigation, "mode_c": self.reasoning, "mode_d": self.subgraph_blocks}
        steps, found = {"routing": asked}, None
        for name in wanted:
            if name == "mode_d" and mode is None:
                continue  # the router never sends a question there
            part = runs[name](asked.where(F.col("mode") == name).select("query_id", "text", "qvec"))
            part = part.select("query_id", F.lit(name).alias("mode"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
            steps[name] = watch(name, part)
            found = steps[name] if found is None else found.unionByName(steps[name])
        steps["merge"] = watch("merge", rank.merge_modes(found))
        return steps

    def trace(self, questions: DataFrame, mode: str | None = None) -> DataFrame:
        """(step, label, n): the stages of :meth:`query` in order with how many rows each gave: routing, the search of each
        mode, the merge. The query runs once; each stage's rows are counted as they pass."""
        seen: list[tuple[str, Observation]] = []

        def watch(name: str, df: DataFrame) -> DataFrame:
            seen.append((name, Observation(f"{name}-{uuid.uuid4().hex}")))
            # a cut table, so that a stage that two later ones read is neither run nor counted twice
            return written(df.observe(seen[-1][1], F.count(F.lit(1)).alias("n")), "trace")

        self._steps(questions, mode, watch)
        rows = [(i, name, seen_by.get["n"]) for i, (name, seen_by) in enumerate(seen, 1)]
        return questions.sparkSession.createDataFrame(rows, "step int, label string, n long")

    def navigation(self, questions: DataFrame) -> DataFrame:
        """Mode B; pages (url, embedding), links (from_url, to_url), and blocks with url and ordinal, whose vectors are joined."""
        vectors = self.table("vectors").select(F.col("vec_id").alias("block_id"), "embedding")
        own = self.table("blocks").select(F.col("doc_id").alias("block_id"), "url", F.col("doc_id").alias("ordinal"))
        out = modes.navigation(self.table("pages"), self.table("links"), own.join(vectors, "block_id", "left"), questions.select("query_id", "qvec"))
        return out.withColumnRenamed("block_id", "id")

    def _seeds(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, weight): the entities (id, embedding) nearest to each question."""
        near = search.knn(self.table("entities"), questions.select("query_id", "qvec"), k, id_col="id")
        return near.select("query_id", "id", F.col("score").alias("weight"))

    def _cut_edges(self) -> DataFrame:
        """The edges as a table: a mode reads them from both ends and for each hop, and what makes them runs once."""
        return written(self.table("edges").select("src", "dst", "relation_type", "weight"), "edges")

    def _mentioned(self) -> DataFrame | None:
        """The blocks, where mentions leave their urls and sizes to them."""
        return None if {"url", "tokens"} <= set(self.table("mentions").columns) else self.table("blocks")

    def reasoning(self, questions: DataFrame) -> DataFrame:
        """Mode C: blocks of the entities near the question and of their neighbours."""
        seeds = self._seeds(questions)
        return modes.reasoning(self._cut_edges(), self.table("mentions"), seeds, seeds.limit(0), blocks=self._mentioned())

    def subgraph(self, questions: DataFrame) -> DataFrame:
        """Mode D's edges: (query_id, a, b, relation_type, weight, rank) among the entities near the question and around."""
        return modes.subgraph(self.table("edges"), self._seeds(questions))

    def subgraph_blocks(self, questions: DataFrame) -> DataFrame:
        """Mode D's blocks, within what its edges leave of the token budget."""
        return modes.subgraph_blocks(self._cut_edges(), self.table("mentions"), self._seeds(questions), blocks=self._mentioned())

    def layered_slice(self, anchor: str | list[str], max_nodes: int = 80) -> DataFrame:
        """The page of an anchor (a url, or an entity's name, alias or id), its blocks, entities, topics and relations, as nodes
        and edges within ``max_nodes``; several anchors at once share the scans. See :func:`graph.layered_slice`."""
        if not 10 <= max_nodes <= 200:
            raise ValueError("max_nodes must be 10 to 200")
        names = ("pages", "blocks", "entities", "mentions", "topics", "edges")
        return graph.layered_slice([anchor] if isinstance(anchor, str) else anchor, *[self.table(n) for n in names], max_nodes=max_nodes)

    def direct(self, questions: DataFrame) -> DataFrame:
        """Mode A; the score is that of the fused ranks."""
        index = self.index() if callable(self.index) else self.index
        return modes.direct(self.table("blocks"), self.table("vectors"), questions, self.settings.retrieval, index=index).withColumnRenamed("rrf", "score")

    def graph_stats(self) -> DataFrame:
        return graph.stats(self.table("nodes"), self.table("edges"))

    def graph_data(self, center: str | None = None, max_nodes: int = 100) -> DataFrame:
        """What lies around ``center``, else a sample of the edges. With tables of entities, blocks, mentions and topics the
        center is found by name, alias or id and has its blocks and topics; else it is a node with its neighbours."""
        names = ("entities", "blocks", "mentions", "topics", "edges")
        if center and set(names) <= self.tables.keys():
            return graph.ego_view([center], *[self.table(n) for n in names])
        if center:
            return graph.ego(self.table("edges"), self.table("nodes"), center)
        return graph.edge_sample(self.table("edges"), max_nodes)

    def neighbors(self, node: str, hops: int = 1, limit: int = 30) -> DataFrame:
        if not (1 <= hops <= 2 and 1 <= limit <= 200):
            raise ValueError("hops must be 1 or 2, limit 1 to 200")
        return graph.neighborhood(self.table("edges"), node, hops, limit)

    def path(self, source: str, target: str, max_depth: int = 4) -> DataFrame:
        if not 1 <= max_depth <= 6:
            raise ValueError("max_depth must be 1 to 6")
        return graph.shortest_path(self.table("edges"), source, target, max_depth)

    def health(self) -> dict[str, str]:
        missing = [t for t in ("blocks", "vectors") if t not in self.tables]
        return {"status": "degraded" if missing else "ok", "missing": ",".join(missing)}
