"""Operator 11 against a plain construction of the same trees."""

import hashlib
import random
import zlib

import pytest

merkle = pytest.importorskip("tessera.llm.merkle")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, text):
    fields = [doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields)


def tree_of(leaves):
    """Levels of digests, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, at, leaf):
    """Siblings on the way up, and the root that ``leaf`` gives in their midst."""
    siblings = []
    for level in levels[:-1]:
        run = level[at - at % 3 : at - at % 3 + 3]
        siblings += run[: at % 3] + run[at % 3 + 1 :]
        leaf = h(run[: at % 3] + [leaf] + run[at % 3 + 1 :])
        at //= 3
    return siblings, leaf


def brute(docs):
    sources = sorted({d["source"] for d in docs}, key=lambda s: b"" if s is None else b"\x01" + s.encode())
    rank = lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf_of(d, d["text"]))
    own = {s: sorted((d for d in docs if d["source"] == s), key=rank) for s in sources}
    trees = {s: tree_of([leaf_of(d, d["text"]) for d in own[s]]) for s in sources}
    above = tree_of([trees[s][-1][0] for s in sources])
    root, out = above[-1][0], []
    for j, s in enumerate(sources):
        for i, d in enumerate(own[s]):
            text = d["text"]
            if text is not None and d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            low, folded = climb(trees[s], i, leaf_of(d, text))
            high, folded = climb(above, j, folded)
            out.append((d["doc_id"], leaf_of(d, d["text"]), trees[s][-1][0], root, h(low + high), folded, folded == root))
    return sorted(out, key=str)


def corpus(spec, seed=1):
    rng = random.Random(seed)
    docs = []
    for source, n in spec:
        for _ in range(n):
            text = rng.choice([None, "", "\n", "plain", "two\nlines", "é\n🙂 " * rng.randint(1, 9)])
            docs.append({"doc_id": len(docs) * 3 % 1_000_003, "text": text, "lang": rng.choice(["en", None]), "source": source, "n_chars": rng.choice([None, len(text or "")]), "leaf": "x", "tree": 7})
    rng.shuffle(docs)
    return docs


def check(spark, docs):
    frame = spark.createDataFrame([tuple(d[c.split()[0]] for c in SCHEMA.split(", ")) for d in docs], SCHEMA).repartition(5)
    got = sorted(map(tuple, merkle.manifest(frame).collect()), key=str)
    assert got == brute(docs)
    return got


@pytest.mark.parametrize("spec", [[("a", 1)], [("a", 2)], [("a", 4), ("b", 1)], [("a", 82), (None, 3), ("é", 1), ("z", 28), ("zz", 81), ("", 5)], [("hot", 700), *[(f"s{i}", 1 + i % 4) for i in range(100)]]])
def test_trees(spark, spec):
    check(spark, corpus(spec))


def test_tampering_shows(spark):
    got = check(spark, corpus([("a", 60), ("b", 9)], 4))
    assert {row[-1] for row in got} == {True, False}


def test_repeated_and_null_ids(spark):
    docs = corpus([("a", 12), (None, 4)], 2)
    for d in docs[:6]:
        d["doc_id"] = None
    docs += [dict(docs[8]) for _ in range(5)] + [dict(docs[9], text="other\n") for _ in range(2)]
    check(spark, docs)


def test_no_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    made = merkle.manifest(frame)
    assert made.count() == 0
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_very_long_text(spark):
    docs = corpus([("a", 3)])
    docs[0]["text"] = "long é\n" * 300_000
    check(spark, docs)


def test_hot_source_is_dealt_out(spark):
    vertices = spark.sparkContext.parallelize([(0, i, 8_100, b"x" * 32) for i in range(8_100)], 4)
    sizes = merkle._placed(vertices, 10).mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sizes == [810] * 10


def test_query(spark):
    from tessera.llm import registry

    sf = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, registry.QUERIES["op11_merkle"](spark, sf).collect()), key=str) == brute(docs)


def test_twin(spark):
    import duckdb

    from tessera.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    result = con.execute(registry.ORACLE_SQL["op11_merkle"])
    made = registry.QUERIES["op11_merkle"](spark, sf)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(made.columns)
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r)) for r in made.select(names).collect())
