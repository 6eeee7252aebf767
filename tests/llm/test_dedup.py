"""Line and substring dedup against brute force."""

import re

import hypothesis.strategies as st
import numpy as np
import pytest
from fixtures import corpus, documents, empty
from hypothesis import given, settings

from panelforge.llm import line_dedup as ld
from panelforge.llm import substring as sub
from panelforge.llm.bloom import bloom_of


def order(rows):
    """Documents in the order of occurrence: id (null first), then place of the text among the id's texts."""
    return sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))


WHITE = " \t\r\x0b\x0c"


def brute_lines(rows, min_lines):
    seen, out = set(), {}
    for doc, text in rows:
        if text is None:
            out[doc, text] = None
            continue
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(WHITE)]
        dead = set()
        for a in range(len(at) - min_lines + 1):
            run = tuple(lines[i].strip(WHITE) for i in at[a : a + min_lines])
            if run in seen:
                dead.update(at[a : a + min_lines])
            seen.add(run)
        out[doc, text] = "\n".join(x for i, x in enumerate(lines) if i not in dead)
    return out


def brute_longest(rows):
    """Of each document the length of its longest run that begins at two places of the corpus."""
    places = [(doc, text, tuple(x.strip(WHITE) for x in (text or "").split("\n") if x.strip(WHITE))) for doc, text in rows]
    out = {}
    for n in range(1, max((len(x) for *_, x in places), default=0) + 1):
        seen = {}
        for doc, text, lines in places:
            for a in range(len(lines) - n + 1):
                seen.setdefault(lines[a : a + n], []).append((doc, text))
        for at in seen.values():
            if len(at) > 1:
                out.update(dict.fromkeys(at, n))
    return out


UNIQUE = [r for r in corpus() if r[0] not in (2, 3, None)] + [corpus()[2]]


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup_is_brute_force(spark, min_lines):
    rows = [*UNIQUE, (70, "\tsame line here \r\nx"), (71, "p\nq\nr\np\nq\nr\np\nq"), (72, "q\nr\nz"), (73, "y\np\nq\nr\np\nw")]
    got = ld.dedup_lines(documents(spark, rows), min_lines).collect()
    want, longest = brute_lines(order(rows), min_lines), brute_longest(rows)
    assert len(got) == len(rows)
    originals = dict(rows)
    for r in got:
        text = originals[r["doc_id"]]
        assert r["text"] == want[r["doc_id"], text]
        assert r["longest_run"] == longest.get((r["doc_id"], text), 0)
        assert r["n_removed"] == len([x for x in r["removed"].split(",") if x])


def test_line_dedup_of_odd_rows(spark):
    rows = corpus()
    got = ld.dedup_lines(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    twice = [r["text"] for r in got if r["doc_id"] == 2]
    assert len(twice) == 2 and len(set(twice)) == 1
    assert [r for r in got if r["doc_id"] == 44][0]["text"] is None
    assert ld.dedup_lines(empty(spark)).collect() == []
    first = {line.strip(WHITE) for _, t in rows if t for line in t.split("\n")}
    kept = {line.strip(WHITE) for r in got if r["text"] for line in r["text"].split("\n")}
    assert first - {""} == kept - {""}  # no line is lost


def test_line_dedup_keeps_columns_and_drops_emptied_documents(spark):
    rows = [(1, "a b\nc d"), (2, "a b\nc d"), (3, "x\na b\nc d"), (4, ""), (5, None), (6, "\t\nc d\n ")]
    got = {r["doc_id"]: r for r in ld.dedup_documents(documents(spark, rows)).collect()}
    assert set(got) == {1, 3, 4, 5} and got[3]["text"] == "x" and got[3]["n_chars"] == 1
    assert got[1].asDict().keys() == documents(spark, rows).first().asDict().keys()


def test_hot_line_and_long_repeats(spark):
    rows = [(i, f"hot line\nown {i}\nhot line\nhot line") for i in range(200)] + [(300 + i, "\n".join(f"l{k}" for k in range(64))) for i in range(3)]
    got = {r["doc_id"]: r for r in ld.dedup_lines(documents(spark, rows, extra=False), 2).collect()}
    want = brute_lines(order(rows), 2)
    assert all(got[d]["text"] == want[d, t] for d, t in rows) and got[301]["text"] == ""
    assert got[300]["longest_run"] == 64 and got[7]["longest_run"] == 2


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=12), min_size=1, max_size=12))
def test_the_suffix_array_and_its_lcps(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    array = ld.common_prefixes(ld.suffix_array(ld.ranked_suffixes(documents(spark, rows, extra=False))))
    got = array.orderBy("at").collect()
    once = {c for c in "abcd" if sum(t.count(c) for t in texts) < 2}
    assert sorted((r["doc_id"], r["seq"]) for r in got) == sorted((d, s) for d, t in enumerate(texts) for s, c in enumerate(t) if c not in once)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    suffix = lambda r: texts[r["doc_id"]][r["seq"] :]
    for a, b in zip(got, got[1:]):
        assert b["lcp"] == common(suffix(a), suffix(b))
    for k, r in enumerate(got):  # each suffix stands beside the one it shares most with
        best = max((common(suffix(r), suffix(o)) for j, o in enumerate(got) if j != k), default=0)
        assert best == max(r["lcp"], got[k + 1]["lcp"] if k + 1 < len(got) else 0)


def all_units(text, line_words, gram):
    """Stretches of words: long lines and paragraphs, the whole, and every passage of ``gram`` words."""
    spans, at, block = set(), 0, None
    for line in [*text.split("\n"), ""]:
        n = len(line.split())
        if n >= line_words:
            spans.add((at, at + n))
        if not n and block is not None:
            if at - block >= line_words:
                spans.add((block, at))
            block = None
        elif n and block is None:
            block = at
        at += n
    if at:
        spans.add((0, at))
    return sorted(spans | {(k, k + gram) for k in range(at - gram + 1)})


def brute_units(rows, line_words, gram):
    """Texts without the units that stand earlier, one document after another."""
    seen, out = set(), {}
    for doc, text in rows:
        if text is None:
            out[doc, text] = None
            continue
        words = text.lower().split()
        places = [m.span() for m in re.finditer(r"\S+", text)]
        spans = []
        for a, b in all_units(text, line_words, gram):
            unit = tuple(words[a:b])
            if unit in seen:
                spans.append((places[a][0], places[b - 1][1]))
            seen.add(unit)
        out[doc, text] = sub.cut(text, spans) if spans else text
    return out


PASTED = [(60 + i, f"own{i} words here " + " ".join(f"p{k}" for k in range(60)) + f" more{i} of it\nand a line{i}") for i in range(4)]
BLOCKS = [(80, "one two\nthree four five\n\n  \nsix seven"), (81, "head\n\nOne  two\nthree four five\n\nlast"), (82, "six seven"), (83, "SIX seven"), (84, "a a a a a a a a a a a a\na a a a a a a a a a a a")]


@pytest.mark.parametrize("line_words,gram", [(25, 10**6), (1, 10**6), (5, 10**6), (5, 8), (10**6, 8)])
def test_substring_dedup_is_brute_force(spark, line_words, gram):
    rows = UNIQUE + PASTED + BLOCKS
    got = sub.dedup_substrings(documents(spark, rows), line_words, gram, 1).collect()
    want = brute_units(order(rows), line_words, gram)
    originals = dict(rows)
    for r in got:
        assert r["text"] == want[r["doc_id"], originals[r["doc_id"]]], r["doc_id"]


def test_no_long_run_is_left_twice(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"t{k}" for k in rng.integers(0, 5000, n))
    shared = [say(n) for n in (50, 50, 51, 70, 120)]
    rows = [(i, f"{say(30)} {shared[i % 5]} {say(20)}\n{say(8)}") for i in range(40)]
    got = {r["doc_id"]: r for r in sub.dedup_substrings(documents(spark, rows, extra=False)).collect()}
    assert [i for i, r in got.items() if not r["n_removed"]] == [0, 1, 2, 3, 4]
    seen = {}
    for i, r in got.items():
        words = r["text"].split()
        for k in range(len(words) - 49):
            assert seen.setdefault(tuple(words[k : k + 50]), i) == i
    for i, r in got.items():  # what is cut is a part of what is shared
        for stretch in filter(None, r["removed"].split(",")):
            a, b = map(int, stretch.split(":"))
            assert dict(rows)[i][a:b] in shared[i % 5]


def test_passages_inside_lines_are_cut_but_for_their_ends(spark):
    got = {r["doc_id"]: r for r in sub.dedup_substrings(documents(spark, PASTED)).collect()}
    passage = PASTED[0][1].split()[3:63]
    assert got[60]["text"] == PASTED[0][1]
    for i in (61, 62, 63):
        left = got[i]["text"].split()
        assert len(set(left) & set(passage)) <= 30 and {f"own{i - 60}", f"more{i - 60}", f"line{i - 60}"} <= set(left)
        a, b = map(int, got[i]["removed"].split(":"))
        assert set(PASTED[i - 60][1][a:b].split()) <= set(passage)


def test_substring_dedup_of_odd_rows(spark):
    got = sub.dedup_substrings(documents(spark)).collect()
    assert len(got) == len(corpus()) and len({r["text"] for r in got if r["doc_id"] == 2}) == 1
    assert [r["text"] for r in got if r["doc_id"] == 44] == [None]
    assert sub.dedup_substrings(empty(spark)).collect() == []
    long = " ".join(f"word{i}" for i in range(30))
    two = sub.dedup_substrings(documents(spark, [(1, long), (2, "head\n" + long.upper() + "\ntail"), (3, long)])).collect()
    assert {r["doc_id"]: r["text"] for r in two} == {1: long, 2: "head\ntail", 3: ""}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=8), st.data())
def test_cut_removes_whole_lines(lines, data):
    dead = data.draw(st.sets(st.integers(0, len(lines) - 1)))
    spans, at = [], 0
    for i, line in enumerate(lines):
        if i in dead:
            spans.append((at, at + len(line)))
        at += len(line) + 1
    assert sub.cut("\n".join(lines), spans) == "\n".join(x for i, x in enumerate(lines) if i not in dead)
    whole = "\n".join(lines)
    assert sub.cut(whole, [(0, len(whole))]) == ""


def test_cut_inside_lines():
    assert sub.cut("a bb c\nd e", [(2, 4)]) == "a c\nd e"
    assert sub.cut("a bb c\nd e", [(2, 8), (7, 8)]) == "a\ne"
    assert sub.cut("a b c d", [(0, 1), (4, 5)]) == "b d"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 9))
def test_winnowing_picks_one_in_every_window(values, spread):
    h = np.array(values, np.uint64)
    picked = set(sub.chosen(h, spread).tolist())
    for j in range(max(1, len(values) - spread + 1)):
        window = range(j, min(len(values), j + spread))
        least = min(values[i] for i in window)
        assert {i for i in window if values[i] == least} <= picked
    assert all(any(values[i] == min(values[j : j + spread]) for j in range(max(0, i - spread + 1), i + 1)) for i in picked)


def test_bloom_holds_what_it_was_built_from(spark):
    h = np.random.default_rng(0).integers(0, 2**63, 2000, dtype=np.uint64)
    b = bloom_of(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"))
    assert b.holds(h).all() and b.holds(h + np.uint64(1)).mean() < 0.05
    assert not bloom_of(spark.createDataFrame([], "h long")).holds(h).any()
