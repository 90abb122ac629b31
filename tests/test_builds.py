"""Stages, chains, questions, stand-in vectors and tools against plain forms of themselves."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import builds, embedding, graph, metadata, pages, tools


def test_stages(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, 2), ("c", None, None)], "g string, x int, y int")
    got = {(r.g, r.stage): (r.complete, r.total, r.state) for r in builds.stage_states(rows, "g", {"x": F.col("x") > 0, "y": F.col("y") > 0, "z": F.lit(None) == 1}, optional=["z"]).collect()}
    assert got == {
        ("a", "x"): (2, 2, "ready"), ("a", "y"): (1, 2, "partial"), ("a", "z"): (0, 2, "empty"), ("b", "x"): (1, 1, "ready"), ("b", "y"): (1, 1, "ready"), ("b", "z"): (0, 1, "empty"),
        ("c", "x"): (0, 1, "missing"), ("c", "y"): (0, 1, "missing"), ("c", "z"): (0, 1, "empty"),
    }
    summary = {r.g: (r.ready, r.partial, r.missing, r.first_open) for r in builds.build_state(builds.stage_states(rows, "g", {"x": F.col("x") > 0, "y": F.col("y") > 0}), "g").collect()}
    assert summary == {"a": (1, 1, 0, "y"), "b": (2, 0, 0, None), "c": (0, 0, 2, "x")}


def test_snapshots_that_are_not_there(spark):
    sizes = spark.createDataFrame([("v1", 10, 2.0), ("v2", 15, 0.0)], "s string, n int, mb double")
    got = {r.measure: tuple(r)[1:] for r in builds.compare_snapshots(sizes, "s", "v1", "v2", ["n", "mb"]).collect()}
    assert got == {"n": (10.0, 15.0, 5.0, 50.0), "mb": (2.0, 0.0, -2.0, -100.0)}
    assert [tuple(r) for r in builds.compare_snapshots(sizes, "s", "v1", "gone", ["n"]).collect()] == [("n", 10.0, None, None, None)]


def test_chain_heads(spark):
    rows = spark.createDataFrame([("p", "rfp", 2), ("p", "rfp", 5), ("p", "plan", 1), ("q", "plan", 7), (None, "rfp", 8), (None, "plan", 9)], "g string, k string, i int")
    assert sorted(map(tuple, builds.head_edges(rows, "g", "k", "rfp", "i").collect())) == [("p", 2, 1), ("p", 2, 5)]


def test_projects_of_a_value(spark):
    nodes = spark.createDataFrame(
        [("p1", "project", "One", 2020), ("p2", "project", "Two", 2023), ("p3", "project", "Three", None), ("m", "method", "Agile", None)],
        "id string, type string, label string, year int"
    )
    edges = spark.createDataFrame([("p1", "m", "USES"), ("p2", "m", "USES"), ("p3", "m", "USES"), ("p3", "m", "USES"), ("p1", "p2", "OTHER")], "src string, dst string, type string")
    ask = lambda name, relation="USES": [r.id for r in builds.projects_with(nodes, edges, {"scrum ": "Agile"}, name, relation, "year").collect()]
    assert ask("Scrum") == ask("agile") == ["p2", "p1", "p3"] and ask("none") == [] and ask("agile", "OTHER") == []


def test_compound_questions(spark):
    kinds = [("proposal", "제안서"), ("kickoff", "착수보고"), ("final", "최종보고")]
    found = builds.compound_question(F.col("q"), kinds, [("isp", "ISP"), ("build", "구축")], ["(K-water|기상청)"], "(.+?)의\\s+(.+)")
    rows = spark.createDataFrame([("K-water isp 제안서의 착수보고서",), ("기상청 AI 프로젝트 최종보고",), ("구축의 제안서",), (None,)], "q string").select(*[c.alias(n) for n, c in found.items()]).collect()
    assert list(map(tuple, rows)) == [("K-water", "isp", "proposal", "kickoff"), ("기상청", None, None, "final"), (None, "build", None, "proposal"), (None, None, None, None)]


def test_hints(spark):
    rules = [("document_group", ["제안서"], "제안서", []), ("project_type", ["업무 시스템", "개선"], "시스템개선", ["업무시스템", "개선"]), ("project_type", ["컨설팅"], "컨설팅", ["컨설팅"]), ("topic", ["AI"], "ai", ["ai", "인공지능"])]
    hints, terms = builds.question_hints(F.col("q"), rules, ["문서"], ["플랫폼", "개선", "문서", "가"])
    rows = spark.createDataFrame([("업무시스템 을 개선 한 제안서 플랫폼 문서 가",), ("ai 컨설팅",), (None,)], "q string").select(hints, terms).collect()
    assert [(dict(r[0]), r[1]) for r in rows] == [
        ({"document_group": "제안서", "project_type": "시스템개선"}, ["업무시스템", "개선", "플랫폼"]), ({"project_type": "컨설팅", "topic": "ai"}, ["컨설팅", "ai", "인공지능"]),
        ({}, [])
    ]


def plain_vector(text, dims):
    state, out = int(hashlib.sha256((text or "").encode()).hexdigest()[:8], 16), []
    for _ in range(dims):
        state = (1_103_515_245 * state + 12_345) & 0x7FFFFFFF
        out.append(state / 0x7FFFFFFF * 2 - 1)
    norm = sum(x * x for x in out) ** 0.5 or 1.0
    return [x / norm for x in out]


def test_stand_in_vectors_and_late_pooling(spark):
    texts = ["", "a", "행정 부", None, "x y  z\nlong word"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", builds.stand_in_vector(F.col("t"), 7).alias("v")).collect():
        assert r.v == pytest.approx(plain_vector(r.t, 7), abs=1e-12)
    spans = F.array(F.struct(F.lit(0).alias("a"), F.lit(3).alias("b")), F.struct(F.lit(90).alias("a"), F.lit(95).alias("b")))
    got = {}
    for r in builds.late_pooled(rows, "i", "t", spans, 3).collect():
        got.setdefault((r.i, r.chunk_index), {})[r.dim] = r.value
    words = ["x", "y", "z", "long", "word"]
    whole = [sum(plain_vector(w, 3)[d] for w in words) / 5 for d in range(3)]
    own = [sum(plain_vector(w, 3)[d] for w in words[:2]) / 2 for d in range(3)]
    assert [got[4, 0][d] for d in range(3)] == pytest.approx([0.65 * o + 0.35 * w for o, w in zip(own, whole)])
    assert [got[4, 1][d] for d in range(3)] == pytest.approx(whole) and (0, 0) not in got and (3, 0) not in got


def test_quality_without_keys_or_structure_is_held_down(spark):
    rows = spark.createDataFrame([(1, "s", "t", "x", 0), (1, "s", "t", "x", 0), (1, "s", "t", "x", 0)], "doc_id int, source string, text string, lang string, n int")
    row = metadata.quality_report(rows, "source", ["text", "owner"], ["doc_id"], "lang", F.lit(False), F.lit(False)).head()
    assert tuple(row) == (0.3, 0.5, 0.0, 0.2, 0.25)
    assert tuple(metadata.quality_report(rows.limit(0), "source", ["text"], ["doc_id"], "lang", F.lit(True), F.lit(True)).head()) == (0.0, 0.0, 0.0, 0.2, 0.05)


@pytest.fixture(scope="module")
def own(spark):
    docs = spark.createDataFrame(
        [(1, "alpha beta\nbeta", "en", "s1", 15), (2, "beta gamma", "en", "s2", 10), (3, "delta", "fr", "s1", 5)],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int")
    nodes = spark.createDataFrame([("p", "project", "Alpha"), ("o", "organization", "Office"), ("t", "technology", "Tech")], "id string, type string, label string")
    edges = spark.createDataFrame([("p", "o", "BY"), ("o", "t", "USES")], "src string, dst string, type string")
    return tools.collection_tools({"documents": docs, "labels": labels}, nodes, edges)


def test_tools_have_schemas_from_their_signatures(own):
    names = "search_documents query_graph_relations get_document_details analyze_data_structure diagnose_data_quality analyze_data_linkage calculate_statistics aggregate_by_field compare_datasets".split()
    assert list(own.tools) == names
    schema = own.schemas()[0]["function"]
    assert schema["parameters"] == {
        "type": "object",
        "properties": {"query": {"type": "string"}, "category": {"type": "string", "default": "all"}, "top_k": {"type": "integer", "default": 10}},
        "required": ["query"]
    }
    assert all(s["function"]["description"] for s in own.schemas())
    with pytest.raises(TypeError):
        own.execute("search_documents")
    with pytest.raises(KeyError):
        own.execute("analyze_data_structure", dataset="nope")


def test_tools_answer(own):
    ids = lambda f, c="doc_id": [r[c] for r in f.collect()]
    assert ids(own.execute("search_documents", query="Delta!")) == [3] and ids(
        own.execute("search_documents", query="delta", category="en")
    ) == [] and own.execute("search_documents", query="?").count() == 0
    assert set(ids(own.execute("query_graph_relations", entity=" alpha "), "id")) == {"o", "t"} and ids(own.execute("query_graph_relations", entity="Alpha", relation_type="technology"), "id") == ["t"]
    assert ids(own.execute("query_graph_relations", entity="Alpha", depth=1), "id") == ["o"]
    assert own.execute(
        "get_document_details", document_id=1, include_chunks=True
    ).head().chunks == ["alpha beta", "beta"] and "chunks" not in own.execute("get_document_details", document_id=1).columns
    assert {r.field: round(r.uniqueness, 3) for r in own.execute("analyze_data_structure").collect()}["lang"] == 0.667
    assert own.execute("diagnose_data_quality", category="en").head().consistency == 1.0
    assert {(r.child_table, r.child_column) for r in own.execute("analyze_data_linkage").collect()} >= {("labels", "doc_id")}
    assert {r.lang: r.n for r in own.execute("calculate_statistics").collect()} == {"en": 2, "fr": 1}
    assert [tuple(r) for r in own.execute("aggregate_by_field", field="source", operation="sum", limit=1).collect()] == [("s1", 20)]
    with pytest.raises(ValueError):
        own.execute("aggregate_by_field", field="nope")
    assert {r.metric: (r.a, r.b) for r in own.execute("compare_datasets", first="s1", second="s2").collect()}["documents"] == (2.0, 1.0)


def test_pages_of_a_text(spark):
    text = "lead\n===== [PAGE 4] =====\nReport on things\n\f\n \n\f2 2.\n| a | b |\n===== [PAGE 2] =====\nAppendix\n[Figure] one\n"
    rows = [r.asDict() for r in pages.page_rows(spark.createDataFrame([(1, text), (2, None), (3, "\n"), (4, "just one report")], "d int, t string"), "d", "t").orderBy("d", "page_no").collect()]
    assert [(r["d"], r["page_no"], r["title"], r["kind"], r["has_table"], r["has_image"]) for r in rows] == [
        (1, 1, "lead", "content", False, False), (
            1, 4, "Report on things", "content", False, False
        ), (1, 5, None, "content", True, False), (1, 6, "Appendix", "appendix", False, True), (4, 1, "just one report", "cover", False, False),
    ]
    assert all(text[r["start"] : r["stop"]].strip() == r["text"] for r in rows if r["d"] == 1)


def test_keywords_against_existing_ones(spark):
    docs = spark.createDataFrame([("Big  Project", "Office", "unknown"), ("office", None, "plan"), ("", "x", "Plan")], "p string, o string, k string")
    existing = spark.createDataFrame([("BIG PROJECT",), ("other",)], "keyword string")
    for overwrite, action in ((True, "updated"), (False, "skipped")):
        got = {r.keyword.lower(): (r.category, r.weight, r.action) for r in pages.keyword_changes(docs, existing, {"p": 2.0, "o": 1.5, "k": 0.8}, overwrite).collect()}
        assert got == {"big project": ("p", 2.0, action), "office": ("p", 2.0, "created"), "plan": ("k", 0.8, "created")}


def test_context_before_embedding(spark):
    rows = spark.createDataFrame([("text", "ok", "ctx", "A"), ("no", "empty", "ctx", "A"), ("bare", "ok", None, " ")], "t string, g string, c string, l string")
    got = [r.embed_text for r in pages.enriched(rows, F.col("t"), F.col("g"), F.col("c"), [F.col("l")]).collect()]
    assert got == ["A\nctx\ntext", None, "bare"]


def test_embedders_that_fail(spark):
    calls, waits = [], []

    def shaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("down")
        return embedding.hashing(8)(texts)

    again = embedding.retried(shaky, tries=3, wait=0.5, sleep=waits.append)
    made = again(["one two", ""])
    assert waits == [0.5, 1.0] and len(calls) == 3 and made.shape == (2, 8)
    assert abs((made[0] ** 2).sum() - 1) < 1e-9 and not made[1].any()
    with pytest.raises(OSError):
        embedding.retried(lambda t: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)(["x"])
    other = embedding.with_fallback(lambda t: (_ for _ in ()).throw(OSError()), embedding.hashing(8))
    assert (other(["one two"]) == made[:1]).all()


def test_guard_words():
    for text in (
        "MATCH (a) DETACH DELETE a", "match (a) set a.x = 1 return a", "CALL apoc.load() RETURN 1", "call `db`.labels() return 1",
        "LOAD CSV FROM 'x' AS r RETURN r", "MATCH (a) RETURN a; MATCH (b) RETURN b", "MATCH (a) // x", "just words", "UNWIND [1] AS x RETURN x"
    ):
        assert not graph.read_only(text), text
    for text in ("MATCH (a)-->(b) RETURN a", "match (settings) return settings.created", "MATCH (a {name: 'delete set'}) RETURN a", "MATCH (a) RETURN a;"):
        assert graph.read_only(text), text
