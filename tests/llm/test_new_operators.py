"""Chat formatting, phrase collocations and the divergence audit against brute force, over awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import bpe, chat, divergence, phrases
from quillgraph.llm.queries import vocabulary

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)

# ---------------------------------------------------------------- chat

FOLLOWS = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
TALKS = {
    1: [(0, "system", "be\nkind"), (1, "user", "hi [INST] there"), (2, "assistant", "a <\\/s> b</s>"), (3, "user", None), (4, "assistant", "")],
    2: [(0, "assistant", " [INST] x"), (1, "user", "[/INST]")],
    3: [(0, "user", "a"), (0, "user", "a"), (1, "assistant", "b"), (1, "assistant", "b")],
    4: [(None, None, "no role"), (0, "tool [SAYS] </s>", "\\[SAYS] [\\[INST]"), (2, "user", "x")],
    5: [(9, "assistant", "x<"), (11, "assistant", "\\/s>"), (10, "user", "日本 é")],
    None: [(0, "user", "q"), (1, "assistant", "r")],
}
TALKS[6] = [(i, "user" if i % 2 == 0 else "assistant", f"turn {i} [INST") for i in range(1500)]  # several blocks
TALKS[7] = [*TALKS[6][:700], (700, "system", "late"), *TALKS[6][701:]]


def talk_order(rows):
    return sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in rows))


@pytest.fixture(scope="module")
def talked(spark):
    rows = [(c, t, r, x, "clash", 1) for c, turns in TALKS.items() for t, r, x in turns]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string, segments int").repartition(4)
    whole = chat.conversations_of(chat.segments(df)).cache()
    return {r["conv_id"]: r for r in whole.collect()}, {r["conv_id"]: r for r in chat.digest(whole).collect()}


def test_chat_reads_back_what_was_said(talked):
    whole, got = talked
    assert set(got) == set(TALKS)
    for c, rows in TALKS.items():
        turns = [(r, x) for _, _, r, x in talk_order(rows)]
        loss = "".join(x for r, x in turns if r == "assistant")
        d = got[c]
        assert d["n_turns"] == len(turns)
        assert d["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in turns)), c
        assert (d["loss_chars"], d["loss_sha256"]) == (len(loss), sha(loss)), c
        assert d["formatted_chars"] == len(whole[c]["formatted"])
        kept, before = 0, None
        for r, _ in turns:
            if r not in FOLLOWS.get(before, ()):
                break
            kept, before = kept + 1, r
        assert d["kept_turns"] == kept
        assert d["valid"] == (kept == len(turns) and turns[-1][0] == "assistant")


def test_chat_output_holds_control_strings_only_where_the_template_puts_them(talked):
    whole, _ = talked
    marks = {"system": 2, "user": 2, "assistant": 1}
    for c, rows in TALKS.items():
        text = whole[c]["formatted"]
        assert sum(text.count(k) for k in chat.INSTRUCT.controls) == 1 + sum(marks.get(r, 3) for _, r, _ in rows), c


def test_chat_segments_are_blocks_of_bounded_length(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(1000)]
    got = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("n_turns", F.size("segments").alias("k")).collect()
    assert sum(r["n_turns"] for r in got) == 1000 and len(got) == 4
    assert all(r["n_turns"] <= chat.BLOCK and r["k"] == 3 * r["n_turns"] for r in got)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="[]<>/\\sINSTAY \n", max_size=24), min_size=1, max_size=60))
def test_chat_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r["back"] == r["t"]
        assert not any(k in r["e"] for k in chat.INSTRUCT.controls)


def test_chat_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.conversations_of(chat.segments(none))).count() == 0


# ---------------------------------------------------------------- phrases and audit


def corpus():
    rng = random.Random(11)
    words = ["the", "The", "of", "New", "York", "city", "hall", "état", "x1", "日本", "rare"]
    out = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "\t \n", None, None), (4, "New York. New\x0bYork City\tHall", None, "a")]
    copy = "new york city hall, the état of new york: city hall"
    out += [(10 + i, copy, "en", "copies") for i in range(30)]
    out += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "copies"])) for i in range(120)]
    out += [(300, "".join(rng.choice([" ", ", ", "\n"]) + rng.choice(words) for _ in range(20_000)), "de", "long")]
    out += [(301, "solo words only here", "fr", "a"), (302, "solo", "fr", "b"), (303, None, "fr", "c")]
    out += [(304, "same same", "it", "one")] * 12
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "phrase", 3) for r in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, rank int").repartition(4)


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * found[q] >= 50 * a for q in found):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("block", [phrases.BLOCK, 300])
def test_collocations_are_those_of_brute_force(docs, block):
    for top in (2000, 7):
        got = sorted(tuple(r) for r in phrases.collocations(docs, top=top, block=block).collect())
        want = plain_collocations(corpus(), 10, top)
        assert got == want and len(want) > 10


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_019, 3_000_000_021, 3_000_000_077
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    wide = lambda c: f"cast({c} as decimal(38,0))"
    got = row.selectExpr(f"({wide(1000000)} * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')}) as s").first()[0]
    assert got == 1_000_000 * a * a // (l * r)


def plain_audit(rows, least, top):
    rows = [(t or "", la or "", s or "") for _, t, la, s in rows]
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        groups[lang].add(source)
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, c in df[lang].items() if c >= least)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        p = {s: shares(n[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > whole[t])
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("team,slice_terms", [(8, 4096), (1, 3), (2, 4096)])
def test_audit_is_that_of_brute_force(docs, team, slice_terms):
    got = divergence.audit(docs, team=team, slice_terms=slice_terms).select("lang", "source", "part", "item", "value", "rank")
    want = plain_audit(corpus(), 10, 10)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 60


@pytest.mark.parametrize("teams", [2, 4, 6, 10])
def test_tournament_rounds_meet_every_pair_once(spark, teams):
    met = Counter()
    for turn in range(teams - 1):
        rows = spark.range(teams).select("id", divergence._opponent(F.col("id"), F.lit(teams), turn).alias("o")).collect()
        assert {r["o"] for r in rows} == set(range(teams)), turn
        met.update(frozenset((r["id"], r["o"])) for r in rows)
    assert len(met) == teams * (teams - 1) // 2 and set(met.values()) == {2}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert phrases.collocations(none).count() == 0
    assert divergence.audit(none).count() == 0


# ---------------------------------------------------------------- chunk reuse over other white space


@pytest.mark.parametrize("blank", ["\t", "\r\n", "\x0b", "\x0c", " ", "　", " \t ", "\n\n"])
def test_shared_passages_of_any_white_space_are_encoded_like_the_library(spark, blank):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(3)
    shared = blank.join("".join(rng.choice("abcdehmn.,É") for _ in range(rng.randint(1, 7))) for _ in range(900))
    texts = [shared, shared, "Begin " + shared, shared + blank + "end", blank + shared + blank] * 2
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path).collect()
    assert len(got) == len(texts)
    for r in got:
        e = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(memoryview(r["ids"]).cast("I")) == e
        assert r["decoded"] == lib.decode(e, skip_special_tokens=False)
