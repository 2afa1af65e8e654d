"""Operators on small rows with values worked out by hand, and properties."""

import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from quillgraph.api import Engine, Forbidden
from quillgraph.config import UrlRules
from quillgraph.functions import expr as E
from quillgraph.operators import dedup, graph, html, kg, lookup, providers, rank, router, search, store, web
from quillgraph.sources import scans
from quillgraph.streaming import incremental

RULES = UrlRules(host_suffixes=("lib.example.edu",))


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("url,reason", [
    ("https://a.edu/tc/study", "lang_mirror"), ("https://a.edu/a/b.PDF", "asset"), ("https://x.lib.example.edu/", "blocked_host"),
    ("https://mylib.example.edu/", None), ("https://a.edu/login", "blocked_path"), ("https://a.edu/login/x", "blocked_path"),
    ("https://a.edu/loginx", None), ("https://a.edu/sitemap/", "boilerplate"), ("https://a.edu/events/2024/recap-2022", "pre_min_year"),
    ("https://a.edu/x/20201", None), ("https://a.edu/recent-focus/20230105_x", "pre_min_year"),
])
def test_drop_reason(spark, url, reason):
    assert one(spark, E.drop_reason(F.lit(url), RULES)) == reason


def test_small_expressions(spark):
    assert one(spark, E.page_type(F.lit("https://a.edu/people/academic-staff/li"))) == "staff-list"
    assert one(spark, E.department(F.lit("https://a.edu/en/news/x"))) == "EN"
    assert one(spark, E.word_count(F.lit("计算 AI lab"))) == 5
    assert one(spark, E.normalized_name(F.lit("Dr. A & B-C  (Hons)"))) == "a and b c(hons)"
    assert [one(spark, E.entity_type(F.lit(x))) for x in (" person ", "UNIVERSITY DEPARTMENT", "LOCATION")] == ["PERSON", "DEPARTMENT", "RESEARCH_AREA"]
    assert [one(spark, E.strength(F.lit(x))) for x in ("12", "abc", "0")] == [10, 5, 1]
    assert round(one(spark, E.block_score(F.lit(0.8), F.lit(3), F.lit(150))), 6) == 0.685
    assert one(spark, router.slug(F.lit("What is Prof. Li's research direction?"))) == "what_is_prof_li_s_research"


def test_indel_ratio():
    assert kg.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd", max_size=12), st.text(alphabet="abcd", max_size=12))
def test_indel_ratio_is_the_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert kg.indel_ratio(a, b) == (2 * t[-1][-1] / (len(a) + len(b)) if a or b else 1.0)


def test_canonical_pick(spark):
    df = spark.createDataFrame([(1, u) for u in ("http://www.m/a", "https://x.m/a", "https://www.m/a/")], "g int, url string")
    assert dedup.pick_canonical(df, "g", "www.m").first()["canonical_url"] == "https://www.m/a/"


def test_page_actions(spark):
    rows = [(f"https://a/{h}{i}", h, 1) for h, n in (("one", 1), ("two", 2), ("many", 19), ("lots", 20)) for i in range(n)]
    rows += [("https://a/e", "e3b0c44298fc", 5), ("https://a/z", "zero", 0), (None, "x", 1), ("https://a/n", None, 1)]
    out = dedup.page_actions(spark.createDataFrame(rows, "url string, content_hash string, n_blocks int"), "a").collect()
    of = lambda h: sorted(r["action"] for r in out if r["content_hash"] == h)
    assert of("one") == ["keep"] and of("two") == ["keep", "mirror"] and of("many") == ["keep"] + ["mirror"] * 18 and set(of("lots")) == {"drop"}
    assert of("e3b0c44298fc") == ["drop"] and of("zero") == ["drop"] and len(out) == 44


def test_compose_remaps(spark):
    df = lambda rows: spark.createDataFrame(rows, "old_id string, new_id string")
    out = {r[0]: r[1] for r in dedup.compose_remaps([df([("a", "b")]), df([("b", "c"), ("d", "d")])]).select("old_id", "new_id").collect()}
    assert out == {"a": "c", "b": "c"}


def test_rewrite_links(spark):
    act = spark.createDataFrame([("k", "keep", "k"), ("m", "mirror", "k"), ("d", "drop", None)], "url string, action string, canonical_url string")
    links = spark.createDataFrame([("k", "m", None, "x"), ("k", "d", "l", "x"), ("k", "o", "l", "y"), ("m", "o", "l", "z"), ("o", "m", "l", "w")], "from_url string, to_url string, link_type string, anchor_text string")
    out = {(r["from_url"], r["to_url"]) for r in dedup.rewrite_links(links, act).collect()}
    assert out == {("k", "o"), ("o", "k")}


def test_budget_and_discount(spark):
    rows = spark.createDataFrame([(1, i + 1, t, "u", 1.0) for i, t in enumerate((1500, 1500, 1500, 100))], "query_id int, rank int, tokens int, url string, score double")
    assert [r["rank"] for r in rank.budgeted(rows, 10, 4000).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["score"] for r in rank.same_page_discount(rows, cap=2).orderBy("rank").collect()] == [1.0, 1.0, 0.5, 0.5]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 900), min_size=1, max_size=12), st.integers(1, 8))
def test_budget_equals_a_loop(spark, tokens, k):
    rows = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(tokens)], "query_id int, rank int, tokens int")
    used, want = 0, []
    for i, t in enumerate(tokens):
        if used >= 1500 or len(want) >= k:
            break
        used += t
        want.append(i + 1)
    assert [r["rank"] for r in rank.budgeted(rows, k, 1500).orderBy("rank").collect()] == want


def test_mmr(spark):
    rows = [(1, 1, 1.0, "u1", ["a", "b"]), (1, 2, 0.9, "u1", ["c", "d"]), (1, 3, 0.0, "u2", ["e", "f"])]
    df = spark.createDataFrame(rows, "query_id long, id long, score double, url string, tokens array<string>")
    pick = lambda lam, k=2: [r["id"] for r in rank.mmr(df, k, lam).orderBy("mmr_rank").collect()]
    assert pick(0.5) == [1, 3] and pick(0.9) == [1, 2] and pick(1.0, 3) == [1, 2, 3]


def test_rrf(spark):
    df = spark.createDataFrame([(1, 1, 9.0, 1.0), (1, 2, 1.0, 5.0)], "query_id int, id int, a double, b double")
    assert rank.rrf_fuse(df, "a", "b").where("id = 1").first()["rrf"] == pytest.approx(0.032522, abs=1e-6)


def test_pack(spark):
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate([5000, 4000, 3000, 9000, 1])], "grp string, ordinal int, tokens long")
    assert [r["batch"] for r in rank.pack(rows).orderBy("ordinal").collect()] == [0, 1, 1, 2, 3]


def test_bm25_negative_idf(spark):
    docs = spark.createDataFrame([(1, "same words"), (2, "same thing")], "doc_id long, text string")
    stats = search.corpus_stats(docs)
    idf = {r["term"]: r["idf"] for r in search.idf(search.vocabulary(docs), stats).collect()}
    import math

    low, mid = math.log(0.5) - math.log(2.5), 0.0
    assert idf["same"] == pytest.approx(0.25 * (low + 2 * mid) / 3)


def test_neighbors_by_paths(spark):
    edges = spark.createDataFrame([("a", "b", "t1", 2.0), ("a", "b", "t2", 1.0), ("b", "c", "t1", 5.0)], "src string, dst string, relation_type string, weight double")
    out = {(r["nbr"], r["path_weight"]) for r in graph.neighbors(edges, spark.createDataFrame([("a",)], "seed string"), 2, 4).collect()}
    assert out == {("c", 7.0), ("a", 3.0)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde"), st.sampled_from(["t", "u"]), st.integers(0, 4)), min_size=1, max_size=18, unique_by=lambda e: e[:3]), st.integers(1, 4))
def test_two_hops_are_those_of_all_paths(spark, edges, m):
    rows = [e for e in edges if e[0] != e[1]]
    both = [(a, b, f"{a}|{b}|{t}", t, w) for a, b, t, w in rows] + [(b, a, f"{a}|{b}|{t}", t, w) for a, b, t, w in rows]
    want = set()
    for seed in "ab":
        one = [(-w, b, 1, e, t) for a, b, e, t, w in both if a == seed]
        two = [(p - w, b, 2, f"{e1}>{e}", t1) for p, x, _, e1, t1 in one for a, b, e, _, w in both if a == x and e != e1]
        best = {}
        for w, b, _, _, t in sorted(one + two)[:m]:
            best.setdefault(b, (seed, b, t, float(-w)))
        want |= set(best.values())
    df = spark.createDataFrame(rows, "src string, dst string, relation_type string, weight int") if rows else spark.createDataFrame([], "src string, dst string, relation_type string, weight int")
    got = graph.neighbors(df, spark.createDataFrame([("a",), ("b",)], "seed string"), 2, m).collect()
    assert {(r["seed"], r["nbr"], r["relation_type"], r["path_weight"]) for r in got} == want


@pytest.mark.parametrize("question,mode", [
    ("Which professors work with Prof. Li and what are their offices respectively", "mode_a"),  # mixed: no single-mode rule
    ("which professors do research on NLP", "mode_c"), ("office and phone respectively", "mode_b"), ("library hours", "mode_a"),
    ("Who does research with Dr. Chan vs Dr. Lee", "mode_b"), ("哪些老师", "mode_c"),
])
def test_router_by_hand(spark, question, mode):
    assert router.route(spark.createDataFrame([(question,)], "text string")).first()["mode"] == mode


def test_page_of_a_block_is_its_own_where_it_can_be(spark):
    held = spark.createDataFrame([("u1", "b"), ("u2", "b"), ("u3", "b"), ("u2", "c"), ("u3", "d")], "url string, block_id string")
    asked = spark.createDataFrame([("b", "u2"), ("c", "u9"), ("e", "u1")], "block_id string, url string")
    assert {(r["block_id"], r["url"]) for r in lookup.page_of_block(held, asked).collect()} == {("b", "u2"), ("c", "u2")}


def test_rerank_ties_go_by_first_rank_and_points_are_one_an_id(spark):
    rows = spark.createDataFrame([(1, 1, "x", 0.5, 2, 0.7), (1, 2, "x", 0.9, 1, 0.7), (1, 3, "", 0.9, 0, 0.9)], "query_id int, id int, content string, first_score double, first_rank int, rerank double")
    assert [r["id"] for r in lookup.reranked(rows).orderBy("rank").collect()] == [2, 1, 3]
    old = spark.createDataFrame([(1, [0.0], 0), (2, [0.0], 0)], "id int, embedding array<double>, at int")
    new = spark.createDataFrame([(2, [1.0], 1), (2, [2.0], 2), (3, [3.0], 1)], "id int, embedding array<double>, at int")
    assert {(r["id"], r["embedding"][0]) for r in lookup.upsert_points(old, new, 1, order="at").collect()} == {(1, 0.0), (2, 2.0), (3, 3.0)}
    with pytest.raises(Exception, match="several new points"):
        lookup.upsert_points(old, new, 1).collect()
    with pytest.raises(TypeError):
        lookup.upsert_points(old, new.withColumn("id", new["id"].cast("string")), 1)


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", "t", 1), ("c", "b", "t", 1), ("c", "d", "t", 1), ("x", "y", "t", 1)], "src string, dst string, relation_type string, weight int")
    assert [r["id"] for r in graph.shortest_path(edges, "a", "d", 4).orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(edges, "a", "y", 4).count() == 0
    with pytest.raises(ValueError):
        graph.shortest_path(edges, "a", "a", 4)


def test_upsert_orphans_and_ring(spark):
    old = spark.createDataFrame([(1, "x", "b1", "b1"), (2, "y", "b1", "b2")], "id int, v string, created_build string, last_seen_build string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    out = {r["id"]: tuple(r)[1:] for r in store.upsert(old, new, ["id"], "b3").collect()}
    assert out == {1: ("x", "b1", "b1"), 2: ("z", "b1", "b3"), 3: ("w", "b3", "b3")}
    builds = spark.createDataFrame([(f"b{i}",) for i in range(8)], "build string")
    ring = store.build_ring(builds).collect()
    assert len(ring) == 6 and [r["build"] for r in ring if r["role"] == "current"] == ["b7"]
    nodes = spark.createDataFrame([("a", "b3"), ("b", "b2"), ("c", None)], "id string, last_seen_build string")
    edges = spark.createDataFrame([("a", "c"), ("a", "b")], "src string, dst string")
    kept, alive = store.delete_orphans(nodes, edges, "b3")
    assert {r["id"] for r in kept.collect()} == {"a", "c"} and alive.count() == 1
    assert nodes.where(store.is_orphan("b3", null_counts=True)).count() == 2


EDGES = "url int, block_id int, depth int"


def test_contains_edges_come_once_and_originals_win(spark):
    old = spark.createDataFrame([(1, 1, 4), (1, 1, 2), (1, 1, None), (1, 2, None), (None, 3, 1), (None, 3, 1)], EDGES)
    new = spark.createDataFrame([(1, 1, 0), (1, 2, 7), (2, 2, 5), (2, 2, 3), (3, 1, None), (3, 1, 6), (None, 3, 8), (None, 3, 9), (4, None, 2)], EDGES)
    out = [tuple(r) for r in store.contains_after_dedup(old, new).collect()]
    kept = [(1, 1, 2, False), (1, 2, None, False), (None, 3, 1, False)]
    assert sorted(out, key=str) == sorted([*kept, (2, 2, 3, True), (3, 1, 0, True), (None, 3, 8, True), (4, None, 2, True)], key=str)
    assert store.contains_after_dedup(old.limit(0), new.limit(0)).collect() == []


def test_contains_edges_of_a_task_are_few_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 20, raising=False)
    monkeypatch.setattr(store, "MOST", 100, raising=False)
    i = F.col("id").cast("int")
    old = spark.range(2000).select((i % 701).alias("url"), (i % 3).alias("block_id"), (i % 5).alias("depth"))
    new = spark.range(3000).select(F.when(i % 2 == 0, 9999).otherwise(i % 997).alias("url"), F.when(i % 2 == 0, 1).otherwise(i % 3).alias("block_id"), (i % 7 + 1).alias("depth"))
    want = {}
    for rows, via in ((old, False), (new, True)):
        for url, block, depth in sorted(map(tuple, rows.collect())):
            want.setdefault((url, block), (depth, via))
    got = store.contains_after_dedup(old, new).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) and {(r["url"], r["block_id"]): (r["depth"], r["via_dedup"]) for r in got} == want
    tasks = [r["task"] for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < 200 < len(want) / 10


def test_router(spark):
    q = spark.createDataFrame([(1, "which professors do NLP?"), (2, "MSc A vs MSc B"), (3, "library hours"), (4, "which professors work with Prof. Li")], "query_id int, text string")
    out = {r["query_id"]: (r["mode"], r["confidence"], r["rule"], r["alt_mode"]) for r in router.route(q).collect()}
    assert out == {1: ("mode_c", 1.0, "heuristic", None), 2: ("mode_b", 0.55, "comparison", None), 3: ("mode_a", 0.5, "default", None), 4: ("mode_a", 0.5, "default", None)}


def test_suggestions(spark):
    rows = spark.createDataFrame([(1, "Q", i, s) for i, s in enumerate(["abc", "What is X?", "what is x?"])], "query_id int, query string, position int, suggestion string")
    assert [r["suggestion"] for r in router.suggestions(rows).collect()] == ["What is X?"]


def test_acronyms(spark):
    a = spark.createDataFrame([("CHC", "Department of History")], "variant string, canonical string")
    q = spark.createDataFrame([(1, "What degrees in CHC?"), (2, "What degrees in chc?")], "query_id int, text string")
    out = {r["query_id"]: r["expanded"] for r in router.expand_acronyms(q, a).collect()}
    assert out == {1: "What degrees in CHC? (CHC = Department of History)", 2: "What degrees in chc?"}


def test_segments_and_blocks(spark):
    para = " ".join(["word"] * 60)
    page = f"<html><head><title>T</title></head><body><h1>Top</h1><div><h2>Part</h2><p>{para}</p><p>{para}</p><p>{para}</p></div><p>short</p></body></html>"
    twins = "<body><p>a<p>b<div>x</div><div id=a>c</div><div id=a>d</div><div id=z>e</div><div>y</div></body>"
    pages = spark.createDataFrame([("u", page), ("s", twins), ("e", ""), ("n", None), ("t", "<p>tiny</p>"), (None, f"<title>Q</title>{para}")], "url string, html string")
    steps = html.segments(html.nodes(pages)).where("url = 's' and level = 1").orderBy("pre").collect()
    assert [r["step"] for r in steps] == ["p[0]", "p[1]", "div[0]", "div#a[1]", "div#a[2]", "div#z", "div[4]"] and [r["child_index"] for r in steps] == list(range(7))
    out = {(r["url"], r["html_tag_path"]): r for r in html.block_tree(pages).collect()}
    assert set(out) == {("u", f"html[0]>body[0]>div[0]>p[{i}]") for i in range(3)} | {("", "body[0]")}
    one = out["u", "html[0]>body[0]>div[0]>p[1]"]
    assert one["heading_context"] == "Top > Part" and one["token_count"] == 60 and one["depth"] == 2 and one["child_index"] == 2 and one["content"] == para
    assert out["", "body[0]"]["heading_context"] == "Q" and out["", "body[0]"]["token_count"] == 61
    assert {r["url"]: r["text"] for r in html.clean_text(pages).collect()}["t"] == "tiny"


def test_blocks_of_deep_and_nested_pages(spark):
    para = " ".join(["word"] * 200)
    deep = "<body>" + "<div>" * 50_000 + f"<h1>H</h1>{para}"
    # a split element whose parts are all too small is one block; headings of an earlier branch come level by level
    small = "<body><div>" + "".join(f"<p>{'few ' * 15}</p>" for _ in range(12)) + "</div></body>"
    order = f"<body><section><div><h3>low</h3></div><h2>high</h2></section><h2>high</h2><table><tr><td><p>{para}</p></td></tr></table><script>no <h1>x</h1></script></body>"
    pages = spark.createDataFrame([("deep", deep), ("small", small), ("order", order), ("order", order)], "url string, html string")
    out = {u: [r for r in rows] for u in ("deep", "small", "order") if (rows := html.block_tree(pages).where(F.col("url") == u).collect())}
    assert [(r["depth"], r["heading_context"]) for r in out["deep"]] == [(50_000, "H")]
    assert [(r["html_tag_path"], r["token_count"]) for r in out["small"]] == [("body[0]>div[0]", 180)]
    assert [(r["html_tag_path"], r["heading_context"]) for r in out["order"]] == [("body[0]>table[0]", "high > low")] * 2  # repeated pages stay apart


def test_layered_slice(spark):
    f = spark.createDataFrame
    tables = {
        "pages": f([("http://p", "Page"), ("http://q", None)], "url string, title string"),
        "blocks": f([("b1", "http://p", " ", "A > B"), ("b2", "http://p", "x" * 80, None), ("b2", "http://p", "x" * 80, None), ("b3", "http://q", None, None)], "block_id string, url string, content string, heading_context string"),
        "entities": f([("e1", "Msc Data", ["DSA"]), ("e2", "Other", None), ("e3", "Third", None)], "entity_id string, name string, aliases array<string>"),
        "mentions": f([("e1", "b1", "http://p"), ("e1", "b2", "http://p"), ("e1", "b2", "http://p"), ("e2", "b1", "http://p"), ("e3", "b2", "http://p"), ("e1", "b3", "http://q")], "entity_id string, block_id string, url string"),
        "topics": f([("e1", "t3"), ("e1", "t1"), ("e1", "t2"), ("e2", "t1"), ("e2", None), ("e3", "t9")], "entity_id string, keyword string"),
        "edges": f([("e1", "e2", "knows"), ("e2", "e3", "knows")], "src string, dst string, relation_type string"),
    }
    engine = Engine(tables)
    rows = engine.layered_slice(["dsa", "http://q", "nobody"], 10).collect()  # 1 page, 2 blocks, e1 costs 3, e2 2, e3 2: all ten
    mine = [r for r in rows if r["anchor"] == "dsa"]
    assert sorted((r["layer"], r["id"], r["label"]) for r in mine if r["kind"] == "node") == [
        ("block", "b1", "B"), ("block", "b2", "x" * 60), ("entity", "e1", "Msc Data"), ("entity", "e2", "Other"), ("entity", "e3", "Third"),
        ("page", "http://p", "Page"), ("topic", "t1", "t1"), ("topic", "t2", "t2"), ("topic", "t9", "t9"),
    ]
    assert sum(r["type"] == "EXTRACTED_FROM" for r in mine) == 4 and sum(r["type"] == "knows" for r in mine) == 2 and sum(r["type"] == "HAS_TOPIC" for r in mine) == 4
    assert {r["id"] for r in rows if r["anchor"] == "http://q" and r["kind"] == "node"} == {"http://q", "b3", "e1", "t1", "t2"}
    assert {r["label"] for r in rows if r["id"] in ("b3",) and r["kind"] == "node"} == {"Block"} and not [r for r in rows if r["anchor"] == "nobody"]
    tight = graph.layered_slice(["dsa"], *[tables[n] for n in ("pages", "blocks", "entities", "mentions", "topics", "edges")], max_nodes=7).collect()
    assert {r["id"] for r in tight if r["layer"] == "entity"} == {"e1"}  # the next costs more than is left, and the list ends there
    with pytest.raises(ValueError):
        engine.layered_slice("dsa", 9)


def test_crawl_and_links(spark):
    pages = spark.createDataFrame([("http://a/x/y", '<a href="z">1</a><a href="/q?x=1">2</a><a href="#t">3</a><a href="mailto:m">4</a><a href="z#f">5</a>')], "url string, html string")
    assert {r["to_url"] for r in web.links(pages).collect()} == {"http://a/x/z", "http://a/q"}
    assert {r["to_url"] for r in html.dom_links(pages).collect()} == {"http://a/x/z", "http://a/q"}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from_url string, to_url string")
    out = {(r["url"], r["depth"]) for r in web.crawl_levels(spark.createDataFrame([("a",)], "url string"), links, 2).collect()}
    assert out == {("a", 0), ("b", 1), ("c", 2)}


def test_embedder_and_answer(spark):
    rows = providers.HashingEmbedder(8).embed(spark.createDataFrame([(1, "a b a"), (2, "")], "id int, text string"), "text").collect()
    assert sum(x * x for x in rows[0]["embedding"]) == pytest.approx(1.0) and sum(rows[1]["embedding"]) == 0


def test_engine(spark):
    edges = spark.createDataFrame([("a", "b", "t", 1)], "src string, dst string, relation_type string, weight int")
    e = Engine({"edges": edges}, forbidden=frozenset({"vectors"}))
    assert e.path("a", "b").count() == 2 and e.health()["status"] == "degraded"
    with pytest.raises(Forbidden):
        e.table("vectors")
    with pytest.raises(ValueError):
        e.query(edges, mode="mode_z")


def test_streaming_ledger_and_upsert(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.ledger(stream, "user_id", "event_type", "ts").writeStream.outputMode("complete").format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["user_id"]: r["status"] for r in spark.table("ledger").collect()}
    assert got == {r["user_id"]: r["status"] for r in store.ledger(events, "user_id", "event_type", ["ts"]).collect()}
    schema = "user_id long, event_type string, created_build string, last_seen_build string"
    latest = stream.select("user_id", "event_type")
    sink = incremental.upsert_sink(spark, str(tmp_path / "out"), ["user_id"], lambda n: f"b{n}", schema)
    run = latest.writeStream.foreachBatch(lambda df, n: sink(df.dropDuplicates(["user_id"]), n)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/v=2")).select("user_id").distinct().count() == events.select("user_id").distinct().count()


def test_dual_writes_survive_a_stop_between_the_two(spark, tmp_path):
    """A build counts when both stores have it; the batch that runs again writes the same; an id is written once."""
    path, stop = str(tmp_path), [True]

    def between():
        if stop:
            stop.pop()
            raise RuntimeError("stopped between the two writes")

    schema = "block_id long, content string, embedding array<double>, ordinal int"
    first = spark.createDataFrame([(1, "a", [1.0], 0), (2, " ", [1.0], 0), (3, "c", None, 0), (1, "b", [2.0], 1)], schema)
    whole = incremental.dual_sink(spark, path, lambda n: f"b{n}")
    whole(spark.createDataFrame([(9, "old", [9.0], 0), (1, "old", [9.0], 0)], schema), 0)
    broken = incremental.dual_sink(spark, path, lambda n: f"b{n}", between=between)
    with pytest.raises(RuntimeError):
        broken(first, 1)
    graph, vectors = incremental.dual_store(spark, path)
    assert {(r["block_id"], r["content"]) for r in graph.collect()} == {(9, "old"), (1, "old")} and vectors.count() == 2
    broken(first, 1)
    broken(first, 1)  # once more: nothing doubles
    graph, vectors = incremental.dual_store(spark, path)
    assert sorted((r["block_id"], r["content"]) for r in graph.collect()) == [(1, "b"), (2, " "), (3, "c"), (9, "old")]
    assert sorted((r["block_id"], r["embedding"][0]) for r in vectors.collect()) == [(1, 2.0), (9, 9.0)]


def test_replies_cut_anywhere_are_mended(spark):
    """A reply cut after any character is either read or has nothing to read, and never gives an item that it has not."""
    import json

    from quillgraph.operators import extraction

    data = {"entities": [{"name": "A \"x\" , ]", "type": "PERSON", "description": "d\\\\e"}, {"name": "B", "type": "zoo"}], "relations": [{"source": "A", "target": "B", "strength": 99, "keywords": ["k", "l"]}]}
    text = json.dumps(data)
    rows = spark.createDataFrame([(i, text[:i]) for i in range(len(text) + 1)] + [(-1, None), (-2, "no json"), (-3, '{"entities": [{"name": 5}, {"name": ""}, "x"]}')], "i int, reply string")
    got = {r["i"]: r for r in extraction.parsed(rows).collect()}
    last = got[len(text)]
    assert [(e["name"], e["type"], e["description"]) for e in last["entities"]] == [('A "x" , ]', "PERSON", "d\\\\e"), ("B", "RESEARCH_AREA", "")]
    assert [(x["source"], x["target"], x["strength"], x["keywords"]) for x in last["relations"]] == [("A", "B", 10, ["k", "l"])]
    n = 0
    for i in range(len(text) + 1):
        r = got[i]
        assert all('A "x" , ]'.startswith(e["name"]) or e["name"] == "B" for e in r["entities"]), text[:i]
        assert len(r["entities"]) >= n or i < 30, text[:i]
        n = max(n, len(r["entities"]))
    assert got[-1]["readable"] and not got[-2]["readable"] and got[-2]["entities"] == []


def test_server_sent_events(spark):
    rows = spark.createDataFrame([(1, "token", ("a",))], "seq int, event string, data struct<t:string>")
    text = incremental.server_sent_events(rows).select(F.col("payload").alias("text"))
    got = incremental.parse_events(text).first()
    assert (got["event"], got["data"]) == ("token", '{"t":"a"}')


def test_boilerplate_is_looked_for_in_the_whole_text(spark, tmp_path):
    from quillgraph.plans import texts

    body = "plain words of a page. " * 20  # more than 200 characters
    rows = [(6, body + "Copyright © 2024"), (7, body + "We use cookies, see our privacy page"), (14, body), (15, "/ menu open close back " + body)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["is_boilerplate"] for r in texts.block_boilerplate_filter(spark, str(tmp_path)).collect()}
    assert got == {6: True, 7: True, 14: False, 15: False}


def test_query_api_runs_the_modes(spark, sf):
    """Mode A's ids come back; a hybrid question gets the best of modes A and B, each scaled on its own."""
    from quillgraph.operators import modes, rank
    from quillgraph.plans import retrieval as r

    q = r._questions(spark, sf)
    e = r._engine(spark, sf)
    direct = {(x["query_id"], str(x["id"])) for x in modes.direct(r._blocks(spark, sf), e.tables["vectors"], q).collect()}
    got = e.query(q, mode="mode_a").collect()
    assert {(x["query_id"], x["id"]) for x in got} == direct and {x["from_modes"] for x in got} == {"mode_a"}
    both = e.query(q, mode="hybrid")
    named = lambda df, m: df.select("query_id", F.lit(m).alias("mode"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
    parts = [named(e.direct(q), "mode_a"), named(e.navigation(q), "mode_b"), named(e.reasoning(q), "mode_c")]
    want = rank.merge_modes(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))
    assert {m for x in both.collect() for m in x["from_modes"].split(",")} == {"mode_a", "mode_b", "mode_c"}
    trace = {x["label"]: x["n"] for x in e.trace(q, mode="hybrid").collect()}
    assert list(trace) == ["routing", "mode_a", "mode_b", "mode_c", "merge"]
    assert trace["routing"] == 3 * q.count() and trace["merge"] == both.count()


def test_modes_need_their_tables(spark):
    one = spark.createDataFrame([(1, "which professors do research", [1.0, 0.0])], "query_id long, text string, qvec array<double>")
    blocks = spark.createDataFrame([(7, "some text", 2, "u7")], "doc_id long, text string, tokens int, url string")
    e = Engine({"blocks": blocks, "vectors": spark.createDataFrame([(7, [1.0, 0.0])], "vec_id long, embedding array<double>")})
    with pytest.raises(KeyError, match="mode_c"):
        e.query(one, mode="mode_c")
    with pytest.raises(KeyError, match="mode_b"):
        e.query(one, mode="hybrid")
    assert e.routed(one).first()["mode"] == "mode_c"
    assert [(r["id"], r["from_modes"]) for r in e.query(one).collect()] == [("7", "mode_a")]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_pack_in_chunks_is_the_running_sum(spark, monkeypatch, chunk):
    import random

    monkeypatch.setattr(rank, "CHUNK", chunk)
    rng = random.Random(2)
    rows = [(g, i, rng.choice([0, 1, 3, 9, 30, None])) for g, n in (("a", 90), ("b", 1), (None, 17), ("hot", 211)) for i in range(n)]
    want = {}
    for g in {r[0] for r in rows}:
        batch, used, items = 0, 0, 0
        for _, i, n in sorted(r for r in rows if r[0] == g):
            n = n or 0
            if items and (used + n > 20 or items >= 4):
                batch, used, items = batch + 1, 0, 0
            used, items = used + n, items + 1
            want[g, i] = batch
    got = rank.pack(spark.createDataFrame(rows, "grp string, ordinal long, tokens long").repartition(3), max_tokens=20, max_items=4).collect()
    assert {(r["grp"], r["ordinal"]): r["batch"] for r in got} == want and len(got) == len(rows)


def test_acronyms_of_a_large_alias_table(spark):
    """No alias is left out, however many there are."""
    from quillgraph.operators import router

    aliases = spark.range(20_000).select(F.concat(F.lit("ZQ"), F.col("id").cast("string")).alias("variant"), F.concat(F.lit("Long name "), F.col("id").cast("string")).alias("canonical"))
    q = spark.createDataFrame([(1, "where is zq19999 and ZQ3?"), (2, "nothing here")], "query_id long, text string")
    got = {x["query_id"]: x["expanded"] for x in router.expand_acronyms(q, aliases).collect()}
    assert got == {1: "where is zq19999 and ZQ3? (ZQ19999 = Long name 19999; ZQ3 = Long name 3)", 2: "nothing here"}


def test_ego_view_finds_its_center_by_alias(spark):
    f = spark.createDataFrame
    tables = {
        "entities": f([("e2", "Msc Data", ["DSA"]), ("e1", "Other", None), ("e3", None, None)], "entity_id string, name string, aliases array<string>"),
        "blocks": f([(f"b{i}", "u", None, "H" * 60 if i else None) for i in range(7)], "block_id string, url string, content string, heading_context string"),
        "mentions": f([("e2", f"b{i}", "u") for i in (6, 5, 4, 3, 2, 0, 0)], "entity_id string, block_id string, url string"),
        "topics": f([("e2", "t"), ("e2", "t"), ("e2", ""), ("e1", "x")], "entity_id string, keyword string"),
        "edges": f([("e1", "e2", "knows"), ("e2", "e1", "knows"), ("e2", "gone", "knows"), ("e2", "e2", "self"), ("e3", "e2", "likes")], "src string, dst string, relation_type string").withColumn("weight", F.lit(1)),
    }
    rows = Engine(tables).graph_data("dsa").collect()
    assert sorted((r["type"], r["id"], r["label"]) for r in rows if r["kind"] == "node") == [
        ("Block", "b0", "Block"), *[("Block", f"b{i}", "H" * 50) for i in (2, 3, 4, 5)], ("Entity", "e1", "Other"), ("Entity", "e2", "Msc Data"), ("Entity", "e3", "e3"), ("TopicKeyword", "t", "t"),
    ]
    assert sorted((r["id"], r["dst"], r["type"]) for r in rows if r["kind"] == "edge" and r["type"] in ("knows", "likes")) == [("e2", "e1", "knows"), ("e2", "e1", "knows"), ("e2", "e3", "likes")]
    assert Engine(tables).graph_data("nobody").count() == 0


def test_scans_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"url": "http://a/x?q=1",\n "title": "A", "outgoing_links": [{"url": "http://b", "anchor_text": "b"}]}')
    (tmp_path / "b.json").write_text("not json")
    store_ = str(tmp_path / "*.json")
    rows = scans.page_store(spark, store_).collect()
    assert [(r["title"], r["outgoing_links"][0]["anchor_text"]) for r in rows] == [("A", "b")]
    assert [r["url"] for r in scans.existing_urls(spark, store_).collect()] == ["http://a/x"]
    (tmp_path / "f.jsonl").write_text('{"url": "http://a"}\n{cut\n\n{"no": 1}\n{"url": "http://c", "more": 2}\n')
    assert {r["url"] for r in scans.frontier(spark, str(tmp_path / "f.jsonl")).collect()} == {"http://a", "http://c"}
    assert scans.config(str(tmp_path / "none.yaml")) == {}
    codes = spark.createDataFrame([(200,), (204,), (408,), (429,), (500,), (503,), (404,), (301,), (None,)], "status int")
    assert [r["c"] for r in codes.select(scans.retry_class().alias("c")).collect()] == ["ok", "ok", "retry", "retry", "retry", "retry", "terminal", "terminal", "terminal"]


def test_fetched_documents_backfill_and_references(spark):
    names = ("url", "source_url", "title", "og_title", "description", "og_description", "markdown", "html")
    docs = spark.createDataFrame([(None, "http://a/fee/x", "", "OG", None, None, "m", "h"), ("http://b/comp/course/1", "http://z", "T", "OG", "D", "OD", None, None)], ", ".join(f"{n} string" for n in names))
    out = {r["url"]: (r["title"], r["meta_description"], r["department"], r["page_type"]) for r in scans.fetched_documents(docs, "now").collect()}
    assert out == {"http://a/fee/x": ("OG", "", "FEE", "fee"), "http://b/comp/course/1": ("T", "D", "COMP", "course")}
    links = spark.createDataFrame([("http://a/study/x/faq",), ("http://a/study/x/faq",), ("http://a/study/y/curriculum",), ("http://a/news",)], "to_url string")
    assert [r["url"] for r in web.backfill(links, spark.createDataFrame([("http://a/study/y/curriculum",)], "url string")).collect()] == ["http://a/study/x/faq"]
    blocks = spark.createDataFrame([("u", 1, "x", "one"), ("u", 2, " ", "blank"), ("v", 1, "y", "other")], "url string, position int, content string, block_id string")
    refs = spark.createDataFrame([("u", " b1"), ("u", "B2"), ("u", "B3"), ("v", "B1"), ("v", None)], "url string, ref string")
    assert {(r["url"], r["block_id"]) for r in kg.block_refs(refs, blocks).collect()} == {("u", "one"), ("v", "other")}
    asked = spark.createDataFrame([("q", 'Standalone question: "What is X?"'), ("q", ""), ("q", None), ("q", "y" * 301), ("q", "'q'")], "raw string, rewritten string")
    assert [r["c"] for r in asked.select(router.contextual(F.col("raw"), F.col("rewritten")).alias("c")).collect()] == ["What is X?", "q", "q", "q", "q"]


def test_a_stored_index_shuffles_no_posting_as_a_row(spark, tmp_path, monkeypatch):
    from quillgraph.operators import bm25

    monkeypatch.setattr(bm25, "GROUP", 3)
    docs = [(1, "b a a c"), (2, None), (3, ""), (4, "a"), (5, "c, C b!"), (6, "zz é 9"), (7, "a b"), (8, "...")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = bm25.build(df, str(tmp_path / "index"), "v")
    rows = index.groups.collect()
    got = {(r["term"], d): round(g, 9) for r in rows for d, g in zip(r["docs"], r["gains"])}
    assert all(r["docs"] == sorted(r["docs"]) and r["most"] == max(r["gains"]) for r in rows)
    lens = {1: 4, 3: 0, 4: 1, 5: 3, 6: 2, 7: 2, 8: 0}
    mean = sum(lens.values()) / len(lens)
    tf = {("a", 1): 2, ("b", 1): 1, ("c", 1): 1, ("a", 4): 1, ("c", 5): 2, ("b", 5): 1, ("zz", 6): 1, ("9", 6): 1, ("a", 7): 1, ("b", 7): 1}
    assert got == {(t, d): round(n * 2.5 / (n + 1.5 * (0.25 + 0.75 * lens[d] / mean)), 9) for (t, d), n in tf.items()}
    assert sorted(d for r in index.members.collect() for d in r["ids"]) == list(range(1, 9))
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {"a": 3, "b": 3, "c": 2, "zz": 1, "9": 1}
    assert not (tmp_path / "index" / "counts").exists()  # the rows of single postings that were written before


def test_largest_gains_are_read_for_the_terms_that_are_asked(spark, tmp_path, monkeypatch):
    from quillgraph.operators import bm25

    monkeypatch.setattr(bm25, "GROUP", 2)
    docs = spark.createDataFrame([(i, "a " * (1 + i % 5) + "b" * (i % 2)) for i in range(12)] + [(12, "z")], "doc_id long, text string")
    index = bm25.build(docs, str(tmp_path / "index"), "v")
    assert index.terms.columns == ["term", "df", "idf"]  # the build gathers no gains of any term
    assert not (tmp_path / "index" / "best").exists()
    own = {}
    for r in index.groups.collect():
        own.setdefault(r["term"], []).extend(r["gains"])
    best = {r["term"]: r["best"] for r in bm25._best(index.groups, 3).collect()}
    assert best == {t: sorted(g, reverse=True)[:3] for t, g in own.items()}
    asked = spark.createDataFrame([(1, "b z"), (2, "a"), (3, "none")], "item_id long, text string")
    every = {(r["query_id"], r["doc_id"], r["rank"]) for r in bm25.search(index, asked, 13, query_id="item_id").collect()}
    few = {(r["query_id"], r["doc_id"], r["rank"]) for r in bm25.search(index, asked, 3, query_id="item_id").collect()}
    assert few == {x for x in every if x[2] <= 3} and len(few) == 9


def test_hits_lie_as_a_table_and_mode_d_needs_no_sparse_index(spark, sf, monkeypatch):
    from quillgraph.operators import search
    from quillgraph.plans import retrieval

    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    hits = search.knn(vectors, vectors.where("vec_id < 2").selectExpr("vec_id as query_id", "embedding as qvec"), 3)
    plan = hits._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Join" not in plan  # read again, a search is not run again
    assert hits.count() == 6

    def forbidden(*_):
        raise AssertionError("mode D asked for the sparse index")

    monkeypatch.setattr(retrieval, "_index", forbidden)
    assert retrieval.query_mode_d(spark, sf).count() > 0


def test_mentions_may_leave_urls_and_sizes_to_their_blocks(spark):
    from quillgraph.operators import modes

    edges = spark.createDataFrame([("a", "b", "r", 2), ("b", "c", "r", 1)], "src string, dst string, relation_type string, weight long")
    seeds = spark.createDataFrame([(1, "a", 0.9), (2, "c", 0.8)], "query_id long, id string, weight double")
    blocks = spark.createDataFrame([(1, "u", 10), (2, "u", 500), (3, None, None), (3, "v", 7), (4, "w", 1)], "doc_id long, url string, tokens int")
    said = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3), ("a", 3), ("c", 9)], "entity_id string, block_id long").selectExpr("*", "cast(null as double) as cosine")
    full = said.join(blocks.withColumnRenamed("doc_id", "block_id"), "block_id")
    for mode in (modes.reasoning, modes.subgraph_blocks):
        args = (seeds, seeds.limit(0)) if mode is modes.reasoning else (seeds,)
        want = sorted(mode(edges, full, *args).collect())
        assert want and sorted(mode(edges, said, *args, blocks=blocks).collect()) == want


def test_pages_are_read_in_small_parts_with_the_same_nodes(spark, monkeypatch):
    from quillgraph.operators import html

    pages = spark.createDataFrame([(f"http://a/{i}", f"<h1>t{i}</h1><p>x <a href='b'>y</a></p>" * (1 + i % 3)) for i in range(7)], "url string, html string").coalesce(1)
    whole = sorted((r["url"], r["pre"], r["tag"] or "", r["text"] or "") for r in html.nodes(pages).collect())
    monkeypatch.setattr(html, "PAGES", 2)
    monkeypatch.setattr(html, "NODES", 5)
    assert whole and sorted((r["url"], r["pre"], r["tag"] or "", r["text"] or "") for r in html.nodes(pages).collect()) == whole


def test_relevance_asks_every_vector(spark, sf):
    from quillgraph.plans import retrieval

    assert retrieval.relevance_hit_at_k(spark, sf).first()["n_queries"] == spark.read.parquet(f"{sf}/embeddings.parquet").count()


@pytest.mark.parametrize("many", [False, True])
def test_nearest_over_many_blocks_is_brute_force_with_ties_by_id(spark, monkeypatch, many):
    import numpy as np

    from quillgraph.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", 50)
    n, k = 1300, 6  # two blocks of queries
    grid = np.random.default_rng(7).integers(-2, 3, (n, 2)).astype(float)  # many equal vectors, some without length
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(grid)], "vec_id long, embedding array<float>").repartition(3)
    hits = search.knn(vectors, vectors.selectExpr("vec_id as query_id", "embedding as qvec"), k, other=True, many=many)
    norm = np.sqrt((grid * grid).sum(axis=1, keepdims=True))
    unit = np.divide(grid, norm, out=np.zeros_like(grid), where=norm > 0)
    scores = np.round(unit @ unit.T, 6) + 0.0
    np.fill_diagonal(scores, -2)
    want = {(i, int(j), r) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), -scores[i]))[:k], 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in hits.collect()} == want


def test_a_sparse_search_joins_no_pairs_of_group_and_term(spark, monkeypatch):
    from quillgraph.operators import bm25

    monkeypatch.setattr(bm25, "GROUP", 4)
    docs = spark.createDataFrame([(i, " ".join("abcdefgh"[(i * j) % 8] for j in range(1 + i % 5))) for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b a"), (2, "c h h"), (3, "none")], "item_id long, text string")
    found = bm25.search(bm25.temporary(docs), asked, 5, query_id="item_id")
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftSemi" in line]
    # a list of such pairs grows with the documents, and Spark would collect it in the driver
    assert joins and not any("term#" in line and "grp#" in line for line in joins)
    assert found.count() == 15
