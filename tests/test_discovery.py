"""Dictionary automata, similar projects and references, each against a plain form of itself."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import dictionary, linkage, similar

WORDS = "layer string, canonical string, form string, parent string"


def plain_terms(docs, words, whole=False):
    """(id, layer, canonical, places, first) by looking for each form in each text."""
    forms = {(la, c, f.lower()) for la, c, f, _ in words if f} | {(la, c, c.lower()) for la, c, _, _ in words}
    out = {}
    for d, text in docs:
        t = (text or "").lower()
        for la, c, f in forms:
            for i in range(len(t) - len(f) + 1) if f else ():
                if t.startswith(f, i) and (not whole or dictionary._whole(t, i, i + len(f))):
                    n, first = out.get((d, la, c), (0, i))
                    out[d, la, c] = n + 1, min(first, i)
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture(scope="module")
def words():
    return [
        (
            "technology", "Spark", "spark sql", "Engines"
        ), ("technology", "Spark", "pyspark", "Engines"), ("technology", "Engines", None, None), ("technology", "SQL", "sql", "Engines"), ("organisation", "Ämter", "amt", None), ("organisation", "행정부", "행정", None),
        ("domain", "aa", "aaa", None), ("method", "Spark", "park", None), ("keyword", "x", "", None), ("section", "Intro", "1. intro", None),
    ]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["PySpark", "spark SQL", " ", "aaaa", "Ämter amt", "행정부", "1. Intro", "park", "\n", "x", "é", "sqlite"]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (7, "sql sql")]


@pytest.mark.parametrize("whole", [False, True])
def test_terms(spark, words, texts, whole):
    docs = spark.createDataFrame([d for d in texts if d[0] != 7], "doc_id long, text string")
    frame = spark.createDataFrame(words + words[:2], WORDS)
    got = sorted(map(tuple, dictionary.terms(docs, frame, whole_words=whole).collect()))
    assert got == plain_terms([d for d in texts if d[0] != 7], words, whole)


def test_a_large_dictionary_is_sharded(spark, words, texts, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_BYTES", 60)
    docs = spark.createDataFrame([d for d in texts if d[0] != 7], "doc_id long, text string")
    got = sorted(map(tuple, dictionary.terms(docs, spark.createDataFrame(words, WORDS)).collect()))
    assert got == plain_terms([d for d in texts if d[0] != 7], words)


def test_no_dictionary_and_no_texts(spark, words, texts):
    docs, frame = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(words, WORDS)
    assert dictionary.terms(docs, frame.limit(0)).count() == 0 and dictionary.terms(docs.limit(0), frame).count() == 0
    assert dictionary.terms(docs, frame).columns == dictionary.terms(docs, frame.limit(0)).columns == ["id", "layer", "canonical", "n", "first"]


def test_layers(spark, words):
    docs = spark.createDataFrame([(1, "pyspark and sql in the amt"), (2, "sql")], "doc_id long, text string")
    frame = spark.createDataFrame(words, WORDS)
    nodes, edges = dictionary.layers(dictionary.terms(docs, frame), frame, {"technology": "USES_TECH", "organisation": "ISSUED_BY"})
    got = {tuple(r) for r in edges.select("src", "dst", "type").collect()}
    assert got == {
        ("document:1", "technology:spark", "USES_TECH"), ("document:1", "technology:sql", "USES_TECH"), (
            "document:1", "organisation:ämter", "ISSUED_BY"
        ), ("document:2", "technology:sql", "USES_TECH"),
        ("technology:engines", "technology:spark", "PARENT_TECH"), ("technology:engines", "technology:sql", "PARENT_TECH"),
    }
    ids = [r.id for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and {e for s, d, _ in got for e in (s, d)} <= set(ids)


# ---- similar projects


def plain_pairs(projects, features, plan, build, least):
    sets = {}
    for item, f in features:
        if f is not None:
            sets.setdefault(item, set()).add(f)
    out = {}
    for (a, oa, ka), (b, ob, kb) in combinations(sorted(projects), 2):
        oa, ob = (oa or "").strip(), (ob or "").strip()
        x, y = sets.get(a, set()), sets.get(b, set())
        if oa and oa == ob:
            out[a, b] = "organisation", 0.8
        elif not oa and not ob and ((ka == plan and kb in build) or (kb == plan and ka in build)):
            out[a, b] = "sequence", 0.7
        elif x and y and len(x & y) / len(x | y) >= least:
            out[a, b] = "composition", round(len(x & y) / len(x | y), 2)
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(12)
    projects = [(i, rng.choice(["", None, " ", "north", "south", "east"]), rng.choice(["plan", "build", "upgrade", "other", None])) for i in range(90)]
    projects += [(i, "hot", "other") for i in range(200, 230)]
    features = [(i, rng.choice("abcdef")) for i, *_ in projects for _ in range(rng.randint(0, 5))] + [(3, None)]
    own = similar.Similar(spark.createDataFrame(projects, "i int, o string, k string"), spark.createDataFrame(features, "i int, f string"), "i", "o", "k", "f", "plan", ["build", "upgrade"])
    return own, projects, features


def test_pairs_equal_brute_force(made):
    own, projects, features = made
    got = {(r.a, r.b): (r.rule, r.score) for r in own.pairs().collect()}
    assert got == plain_pairs(projects, features, "plan", ("build", "upgrade"), 0.6)


def test_counts_equal_brute_force(made):
    own, projects, features = made
    want = {i: {"organisation": 0, "sequence": 0, "composition": 0} for i, *_ in projects}
    for (a, b), (rule, _) in plain_pairs(projects, features, "plan", ("build", "upgrade"), 0.6).items():
        want[a][rule] += 1
        want[b][rule] += 1
    got = {r.item: {"organisation": r.by_organisation, "sequence": r.by_sequence, "composition": r.by_composition} for r in own.counts().collect()}
    assert got == want


def test_a_shared_value_is_one_link(made):
    own, _, _ = made
    rows = own.links.collect()
    assert sum(r.rule == "organisation" and r.a == "hot" for r in rows) == 1
    assert {(r.a, r.b) for r in rows if r.rule == "sequence"} == {("plan", "build"), ("plan", "upgrade")}
    assert own.members.count() == 120 and own.classes.agg(F.sum("size")).head()[0] == 120


def test_no_projects(spark):
    own = similar.Similar(spark.createDataFrame([], "i int, o string, k string"), spark.createDataFrame([], "i int, f string"), "i", "o", "k", "f", "p", ["b"])
    assert own.counts().count() == own.links.count() == own.pairs().count() == 0


# ---- references


def test_references(spark):
    rng = random.Random(1)
    orders = spark.createDataFrame([(i, rng.randint(1, 40), f"n{i % 7}", None) for i in range(500)], "o_id int, o_cust long, o_name string, o_none string")
    custs = spark.createDataFrame([(i, f"n{i}", "z" * 100 + str(i)) for i in range(1, 41)], "c_cust long, c_name string, c_long string")
    notes = spark.createDataFrame([("z" * 100 + str(i),) for i in (1, 2, 2)] + [(None,)], "t_long string")
    twice = spark.createDataFrame([(1,), (1,), (2,)], "w_cust int")
    nulls = spark.createDataFrame([(1,), (None,)], "u_cust int")
    got = {tuple(r) for r in linkage.references({"o": orders, "c": custs, "t": notes, "w": twice, "u": nulls, "e": twice.limit(0)}).collect()}
    assert got == {
        ("o", "o_cust", "c", "c_cust", orders.select("o_cust").distinct().count(), 40, True), ("c", "c_cust", "o", "o_id", 40, 500, False), ("t", "t_long", "c", "c_long", 2, 40, True),
        ("w", "w_cust", "c", "c_cust", 2, 40, True), ("w", "w_cust", "o", "o_id", 2, 500, False), ("u", "u_cust", "c", "c_cust", 1, 40, True), ("u", "u_cust", "o", "o_id", 1, 500, False), (
            "o", "o_cust", "o", "o_id", orders.select("o_cust").distinct().count(), 500, False
        ),
    }


def test_sketches_spare_what_cannot_be(spark):
    tables = {
        "a": spark.range(5_000).select(F.col("id").alias("a_id"), (F.col("id") + 100_000).alias("a_far")),
        "b": spark.range(2_000).select((F.col("id") * 2).alias("b_id"), (F.col("id") * 3).alias("b_other"))
    }
    profiles = linkage.profile("a", tables["a"]).unionByName(linkage.profile("b", tables["b"]))
    found = {(r.ct, r.cc, r.pt, r.pc) for r in linkage.candidates(profiles).collect()}
    assert ("b", "b_id", "a", "a_id") in found and not any("a_far" in r for r in found) and ("b", "b_other", "b", "b_id") not in found
    assert linkage.references({"a": spark.createDataFrame([], "x double")}).count() == 0
