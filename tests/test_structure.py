"""Contents trees, chunks, word stems, fields, scopes and paths against plain forms of themselves."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from tessera.operators import fields, graph, outline, scopes, wordforms

# ---- contents


def plain_tree(entries, last):
    out = []
    for i, (no, level, title, page) in enumerate(entries):
        chain, want = [], level
        for no2, level2, title2, _ in reversed(entries[:i]):
            if level2 < want:
                chain.insert(0, (no2, title2))
                want = level2
        pages = [page] + [p for *_, p in entries[i + 1 :]]
        own = next((p for p in pages if p is not None), None)
        follows = next((j for j in range(i + 1, len(entries)) if entries[j][1] <= level), None)
        if follows is None:
            end = last
        else:
            nxt = next((p for *_, p in entries[follows:] if p is not None), None)
            end = max((x for x in (own, None if nxt is None else nxt - 1) if x is not None), default=None)
        out.append((no, level, title, chain[-1][0] if chain else None, " > ".join([t for _, t in chain] + [title]), own, end))
    return out


def test_trees_equal_plain_ones(spark):
    rng = random.Random(4)
    docs = {d: [(i, rng.randint(1, 3), f"t{i}", rng.choice([None, i * 2 + 1])) for i in range(rng.randint(1, 14))] for d in range(40)}
    frame = spark.createDataFrame([(d, *e) for d, es in docs.items() for e in es], "d int, line_no int, level int, title string, page int")
    got = defaultdict(list)
    for r in outline.section_tree(frame, "d", F.lit(99)).orderBy("d", "line_no").collect():
        got[r.d].append(tuple(r)[1:])
    assert got == {d: plain_tree(es, 99) for d, es in docs.items()}


def test_contents_lines(spark):
    text = "Contents\nI. Overview ........ 3\n1.1 Aims 4\n  1.1.2. Scope and 2024 plans ..... 12\n2-3 개요 · · 7\n가. 목적\nplain line\n12. \n3. 50\n2. Ends here"
    rows = [tuple(r)[1:] for r in outline.contents_lines(spark.createDataFrame([(1, text), (2, None)], "d int, t string"), "d", "t").orderBy("line_no").collect()]
    assert rows == [(1, 1, "Overview", 3), (2, 2, "Aims", 4), (3, 3, "Scope and 2024 plans", 12), (4, 2, "개요", 7), (5, 2, "목적", None), (9, 1, "Ends here", None)]


def test_covers(spark):
    text = "\n 제안요청서 2024\n발주기관: 가나다 공사\n2025년 3월\n"
    found = outline.cover(F.col("t"), ["(?m)^사업명: *([^\n]+)$"], ["발주기관: *([^\n]+)"], [], ["제안요청서"])
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in found.items()]).head()
    assert tuple(row) == ("제안요청서 2024", "가나다 공사", "2024", "2025-03", "제안요청서", 1.0)
    empty = spark.createDataFrame([(None,), ("",)], "t string").select(*[c.alias(n) for n, c in found.items()]).collect()
    assert all(tuple(r) == (None, None, None, None, None, 0.0) for r in empty)


def test_canonical_sections(spark):
    aliases = {"추진 전략": ["전략"], "Method": ["procedure"]}
    texts = ["Ⅱ. 추진전략 (1/3)", "3.2 The PROCE-DURE", "none", None, "1. 사업 전략"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(outline.canonical_section(F.col("t"), aliases)).collect()
    assert [r[0] for r in rows] == ["추진 전략", "Method", None, None, "추진 전략"]


def test_slide_sections_that_come_again(spark):
    slides = spark.createDataFrame(
        [(1, n, s, w) for n, s, w in [(1, "a", ["x", "both"]), (2, "a", ["x"]), (3, "b", ["y", "both"]), (5, "a", ["z"]), (6, "a", []), (6, "a", ["z"])]],
        "d int, n int, s string, w array<string>"
    )
    got = {r.s: tuple(r)[2:] for r in outline.slide_outline(slides, "d", "n", "s", F.col("w")).collect()}
    assert got == {"a": (1, 6, "1~2, 5~6", 4, "x z"), "b": (3, 3, "3", 1, "y")}


# ---- chunks within a page


def plain_chunks(text, size, overlap):
    units = [u for u in re.findall("(?s)(?:.{0,%d}?(?:\n|[.!?。] )|.{1,%d}?\\Z|.{%d})" % (size - 2, size, size), text) if u]
    out, start = [], 0
    for i in range(len(units)):
        if sum(map(len, units[start : i + 1])) > size:
            out.append((start, i))
            start = next(t for t in range(start + 1, i + 1) if sum(map(len, units[t:i])) <= overlap and sum(map(len, units[t : i + 1])) <= size)
    if units:
        out.append((start, len(units)))
    return [(n, sum(map(len, units[:a])), "".join(units[a:b])) for n, (a, b) in enumerate(out)]


@pytest.mark.parametrize("size,overlap", [(1000, 300), (60, 25), (20, 0)])
def test_page_chunks(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice(["word ", "end. ", "줄바꿈\n", "x" * rng.randint(1, 90), "Oh! "]) for _ in range(rng.randint(0, 80))) for _ in range(40)] + ["", None, "y" * 2_500, "\n\n\n"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "d int, p int, t string")
    got = defaultdict(list)
    for r in outline.page_chunks(pages, "d", "p", "t", size, overlap).orderBy("d", "chunk_no").collect():
        got[r.d].append((r.chunk_no, r.start, r.text))
    for i, text in enumerate(texts):
        assert got[i] == plain_chunks(text or "", size, overlap), (i, text)
        assert all(len(c) <= size and (text or "")[s : s + len(c)] == c for _, s, c in got[i])
        covered = {k for _, s, c in got[i] for k in range(s, s + len(c))}
        assert covered == set(range(len(text or "")))


# ---- word stems


def plain_stems(words, least=2, shortest=2):
    counts = Counter(words)
    n, follows = Counter(), defaultdict(Counter)
    for form, c in counts.items():
        for k in range(1, min(len(form), 20) + 1):
            n[form[:k]] += c
            follows[form[:k]][form[k : k + 1] or "$"] += c
    def score(s):
        cohesion = round((n[s] / n[s[0]]) ** (1 / (len(s) - 1)), 9)
        entropy = round(max(0.0, -sum(c / n[s] * math.log(c / n[s]) for c in follows[s].values())), 9)
        return round(cohesion * entropy, 9)
    out = {}
    for form in counts:
        options = [(score(form[:k]), k) for k in range(shortest, min(len(form), 20) + 1) if len(follows[form[:k]]) >= least]
        best = max(options, default=(0.0, len(form)))
        out[form] = form[: best[1]]
    return out, n, follows


@pytest.fixture(scope="module")
def hangul():
    nouns, particles = ["정보", "시스템", "데이터", "사업", "전략"], ["", "는", "을", "의", "에서"]
    rng = random.Random(9)
    return [(i, " ".join(rng.choice(nouns) + rng.choice(particles) for _ in range(30))) for i in range(12)] + [(50, None), (51, "abc 123")]


def test_stems_equal_brute_force(spark, hangul):
    docs = spark.createDataFrame(hangul, "d int, t string")
    counted = wordforms.forms(docs, "t")
    words = [w for _, t in hangul for w in re.findall("[가-힣]+", t or "")]
    want, n, follows = plain_stems(words)
    assert {r.form: r.stem for r in wordforms.stems(counted).collect()} == want
    assert {r.start: (r.n, r.kinds) for r in wordforms.beginnings(counted).collect()} == {s: (n[s], len(follows[s])) for s in n}
    # the particles are cut
    assert {want[w] for w in want} == {"정보", "시스템", "데이터", "사업", "전략"}


def test_keywords_and_compounds(spark, hangul):
    docs = spark.createDataFrame(hangul, "d int, t string")
    stems, *_ = plain_stems([w for _, t in hangul for w in re.findall("[가-힣]+", t or "")])
    for compounds in (True, False):
        got = {}
        for r in wordforms.keywords(docs, "d", "t", most=6, compounds=compounds).collect():
            got.setdefault(r.id, {})[r.keyword] = r.n
        for d, t in hangul:
            words = re.findall("[가-힣]+", t or "")
            counts = Counter(stems[w] for w in words)
            if compounds:
                counts.update(f"{stems[a]} {stems[b]}" for a, b in zip(words, words[1:]) if a == stems[a])
            assert got.get(d, {}) == dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:6])


# ---- fields


def test_labelled(spark):
    texts = ["발주기관 ( 가나 공사 ) 끝", "x\n발주기관 : 다라 청\n", "발주기관명: no", "발주기관: a", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fields.labelled(F.col("t"), ["발주기관", "주관기관"])).collect()
    assert [r[0] for r in rows] == ["가나 공사", "다라 청", None, None, None]


def test_organisations_by_frequency(spark):
    rows = [
        (1, "Owner: Said House\nAbc Office"), (2, "Abc Office Abc Office and Xyz Office"), (3, "Xyz Office and Abc Office"),
        (4, "Common Office Common Office"), (5, "Common Office"), (6, "Common Office, Common Office, Rare Office"), (7, "Common Office"), (8, None)
    ]
    got = {
        r.id: (r.organisation, round(r.confidence, 6)) for r in fields.organisations(
            spark.createDataFrame(rows, "d int, t string"), "d", "t", ["Owner"], "[A-Z][a-z]+ Office", spread=0.4
        ).collect()
    }
    assert got == {1: ("Said House", 0.9), 2: ("Abc Office", 0.63), 3: ("Abc Office", 0.6), 6: ("Rare Office", 0.6)}


def test_projects_and_lines(spark):
    name, sure = fields.project(F.col("t"), F.col("f"), ["사업명"], "[가-힣]+ 구축", "_최종|[0-9]{4}")
    rows = spark.createDataFrame([("사업명: 차세대 시스템\n", "a.hwp"), ("우리는 정보 구축", "b.hwp"), ("none", "2024 제안서_최종.pptx"), (None, None)], "t string, f string").select(name, sure).collect()
    assert list(map(tuple, rows)) == [("차세대 시스템", 0.88), ("정보 구축", 0.6), ("제안서", 0.75), (None, 0.0)]
    org = fields.organisation_of_lines(F.col("t"), ["기관"], ["[가-힣]+공단"], ["청", "부"])
    year, month = fields.dated(F.col("t"))
    lines = spark.createDataFrame([("\n머리\n기관: 가나\n2024년 11월",), ("기관 (다라)\n2023.7.",), ("우리공단 자료\n2035-13",), ("조달청\nno",), (None,)], "t string").select(org, year, month).collect()
    assert list(map(tuple, lines)) == [("가나", 2024, 11), ("다라", 2023, 7), ("우리공단", 2035, None), ("조달청", None, None), (None, None, None)]


# ---- scopes


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [("s1", "a", True, False, 1), ("s2", "a", True, False, 2), ("s3", "a", False, False, 3), ("s4", "b", True, True, 1), ("s5", "c", False, False, 1)]
    return spark.createDataFrame(rows, "snapshot string, source string, queryable boolean, active boolean, made_at int")


@pytest.mark.parametrize(
    "wanted,scope,held",
    [
        (None, "active_snapshot", {"s4"}), ("all_sources", "all_sources", {"s2", "s4"}), ("source:a", "source:a", {"s2"}),
        ("mine", "mine", {"s1", "s4"}), ("source:c", "active_snapshot", {"s4"}), ("void", "active_snapshot", {"s4"})
    ],
)
def test_scopes(catalogue, wanted, scope, held):
    rows = scopes.resolve(catalogue, wanted, {"mine": [("s1", None), (None, "b"), ("s9", None)], "void": [("s9", None)]}).collect()
    assert {r.scope for r in rows} == {scope} and {r.snapshot for r in rows} == held


def test_a_default_that_holds_nothing(catalogue):
    rows = scopes.resolve(catalogue.withColumn("active", F.lit(False)), None).collect()
    assert {(r.scope, r.snapshot) for r in rows} == {("all_sources", "s2"), ("all_sources", "s4")}
    assert scopes.resolve(catalogue.limit(0), "x").count() == 0


def test_only_a_scope_s_folders_are_read(spark, catalogue, tmp_path):
    path = str(tmp_path / "vectors")
    scopes.write_vectors(
        spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.concat(F.lit("s"), (F.col("id") % 5 + 1).cast("string")).alias("snapshot")),
        path
    )
    found = scopes.scoped(spark, path, scopes.resolve(catalogue, "source:a"))
    assert {r.vec_id for r in found.collect()} == {i for i in range(100) if i % 5 == 1}
    plan = found._jdf.queryExecution()
    plan.executedPlan().execute().count()
    text = plan.executedPlan().toString()
    assert "dynamicpruning" in text.lower()
    leaves = plan.executedPlan().collectLeaves()
    read = [leaves.apply(i).metrics().get("numPartitions").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numPartitions")]
    assert not read or min(read) == 1


# ---- paths


def test_paths_equal_brute_force(spark):
    rng = random.Random(7)
    names = "abcdefghij"
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(11)}
    edges = spark.createDataFrame([(a, b, "T") for a, b in pairs], "src string, dst string, type string").cache()
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def plain(a, b, most):
        level = [[a]]
        for _ in range(most + 1):
            hits = sorted(p for p in level if p[-1] == b)
            if hits:
                return hits[0]
            level = [p + [x] for p in level for x in near[p[-1]] if x not in p]
        return []

    asked = rng.sample(list(product(names, names)), 12) + [("a", "a"), ("a", "z")]
    for a, b in asked:
        most = 5
        got = [r.id for r in graph.shortest_path(edges, a, b, most).orderBy("step").collect()]
        want = plain(a, b, most)
        assert got == (want if len(want) <= most + 1 else []), (a, b)


def test_both_ends_grow_by_the_smaller_frontier(spark):
    hub = [("a", "hub", "T"), ("hub", "z", "T"), ("z", "end", "T"), ("end", "far", "T")] + [("hub", f"leaf{i}", "T") for i in range(40)]
    edges = spark.createDataFrame(hub, "src string, dst string, type string")
    sizes = []
    got = [r.id for r in graph.shortest_path(edges, "a", "far", 5, sizes=sizes).orderBy("step").collect()]
    assert got == ["a", "hub", "z", "end", "far"]
    assert max(n for _, n in sizes) <= 2 and {side for side, _ in sizes} == {"start", "end"}
