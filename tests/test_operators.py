"""Sources, chunking, streams, guards and stage runs that have no SQL twin."""

import io
import random
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, graph, metadata, upkeep
from tessera.plans import building, catalog
from tessera.sources import files
from tessera.streaming import append


def test_scan_and_features(spark, tmp_path):
    for p in ("01. RFP/a.txt", "02. Plan/sec/20240101. Proj/b.TXT", "c.md"):
        (tmp_path / "root" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / p).write_text("x y")
    found = files.scan(spark, str(tmp_path / "root"))
    rows = {r.name: r for r in files.path_features(found, {"RFP": "rfp"}).collect()}
    assert rows["a.txt"].category == "rfp" and rows["a.txt"].section is None
    assert rows["b.TXT"].ext == "txt" and rows["b.TXT"].section == "sec" and rows["b.TXT"].project.startswith("20240101")
    assert rows["c.md"].category is None
    assert {(r.ext, r.n) for r in files.extension_summary(found).collect()} == {("txt", 2), ("md", 1)}
    assert files.scan(spark, str(tmp_path / "root"), depth=2).count() == 2


def test_relative_paths_keep_folders_named_like_the_root(spark, tmp_path):
    for p in ("root/x/root/y.txt", "root/it's/z.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = {r.relative_path for r in files.scan(spark, f"file://{tmp_path}/root/").collect()}
    assert "x/root/y.txt" in found and len(found) == 2


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "q.csv").write_text(';[1]\n"a,b",c\n"two\nlines",""\n')
    got = files.page_marker_csv(spark, str(tmp_path / "q.csv")).collect()
    assert [(r.page_num, r.text) for r in got] == [(1, "a,b c\ntwo\nlines")]


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Name</t></si><si><r><t>Two</t></r><r><t xml:space='preserve'> parts</t></r></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"/><c r="C1"><v>4.5</v></c></row><row r="2"><c t="inlineStr"><is><t>A &amp; B</t></is></c></row></sheetData></worksheet>'
        )
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet><row><c t="s"><v>1</v></c></row></worksheet>')
    (row,) = files.extract(spark, str(tmp_path)).collect()
    assert row.status == "done" and row.text == "===== [PAGE 1] =====\nName | 4.5\nA & B\n===== [PAGE 2] =====\nTwo parts"


def test_upserts_keep_the_last_row(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, at int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 3), (2, "z", 2), (None, "n", 1)], "k long, v string, at int")
    got = sorted(((r.k, r.v) for r in upkeep.upsert(old, new, "k", "at").collect()), key=str)
    assert got == [(1, "a"), (2, "y"), (None, "n")]


def test_review_and_purge(spark):
    rows = spark.createDataFrame([(1, None), (2, "2026-01-01 00:00:00"), (3, "2026-03-01 00:00:00")], "k long, r string").select("k", F.col("r").cast("timestamp").alias("removed_at"))
    assert {r.k for r in upkeep.purge(rows, F.lit("2026-03-10 00:00:00").cast("timestamp"), 30).collect()} == {1, 3}
    assert {(r.status, r.reject_reason) for r in upkeep.reject(rows, "blurred").collect()} == {("rejected", "blurred")}


def test_manifests_and_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [1.0, 2.0]), (3, "b", [0.0, 1.0])], "id long, doc string, embedding array<double>")
    files.write_vectors(rows, f"{tmp_path}/v", "doc")
    back = spark.read.parquet(f"{tmp_path}/v")
    assert back.filter("doc = 'b'").count() == 2 and "doc" in back.filter("doc = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc, r.vectors, r.dims) for r in files.vector_manifest(back, "doc").collect()} == {("a", 1, 2), ("b", 2, 2)}
    files.write_manifest(rows.select("id", "doc"), f"{tmp_path}/m")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/m/csv").count() == spark.read.json(f"{tmp_path}/m/jsonl").count() == 3


def test_hits_of_unknown_documents_stay(spark, tmp_path):
    from tessera.plans import search

    spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (9, [0.9, 0.2], 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "s", "en"), (1, "t", "en"), (2, "u", "en")], "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.vec_id, r.source) for r in search.hits(spark, str(tmp_path)).collect()} == {(0, "s"), (1, "t"), (9, None)}


def test_rerank_takes_every_hit_of_a_source(spark, tmp_path):
    from tessera.plans import search

    rows = [(i, [1.0, i / 10], 1) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(i, "of the", "s", "en") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r["rank"], r.doc_id) for r in search.rerank_docs(spark, str(tmp_path)).collect()) == [(i + 1, i) for i in range(8)]
    assert search.hits(spark, str(tmp_path)).count() == 5


def test_similar_sets_against_brute_force(spark):
    import random

    rng = random.Random(2)
    sets = {i: set(rng.sample(range(30), rng.randint(1, 9))) for i in range(60)}
    pairs = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s], "item int, feature int")
    for least in (0.3, 0.5, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b) for r in graph.similar_by_sets(pairs, "item", "feature", least).collect()} == want


def test_projection_against_numpy(spark):
    import numpy as np

    from tessera.operators.projection import pca

    x = np.random.RandomState(1).randn(200, 5) * [5, 3, 1, 0.5, 0.1]
    got = pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "id", "v", 2).orderBy("id").collect()
    values, directions = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ directions[:, ::-1][:, :2]
    for c in range(2):
        assert np.allclose(np.abs([r[f"component_{c}"] for r in got]), np.abs(want[:, c]))
    assert abs(got[0].share - values[::-1][:2].sum() / values.sum()) < 1e-9


def test_rows_only_queries_have_the_right_rows(spark):
    import json

    from tessera.plans import catalog

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counted = {}
    for r in docs.select("source", "lang").collect():
        counted.setdefault(r.source, {}).setdefault(r.lang, []).append(1)
    pages = {r.source: r.markdown for r in catalog.QUERIES["wiki_pages"](spark, folder).collect()}
    assert pages == {s: f"# {s}\n\n" + "\n".join(sorted(f"- {k}: {len(v)} documents" for k, v in own.items())) for s, own in counted.items()}
    shown = [(r.kind, json.loads(r.json)) for r in catalog.QUERIES["graph_visual"](spark, folder).collect()]
    ids = {x["id"] for k, x in shown if k == "node"}
    assert len(ids) <= 200 and all(x["src"] in ids and x["dst"] in ids for k, x in shown if k == "edge") and any(k == "edge" for k, _ in shown)


def test_fuzzy_sentences(spark):
    from tessera.operators import filters

    rows = spark.createDataFrame([(1, "The road map of the city. Nothing here! Roadmaps, city."), (2, None), (3, "")], "id long, text string")
    got = [(r.id, r.sentence, r["rank"]) for r in filters.fuzzy_sentences(rows, "id", "text", "road city", 0.6).orderBy("rank").collect()]
    assert got == [(1, "Roadmaps, city", 1), (1, "The road map of the city", 2)]


def test_graph_answers(spark):
    from tessera.operators import knowledge

    nodes = spark.createDataFrame([("s1", "supplier", "S1"), ("n1", "nation", "N1"), ("r1", "region", "North"), ("r2", "region", "South")], "id string, type string, label string")
    edges = spark.createDataFrame([("s1", "n1", "IN_NATION"), ("n1", "r1", "IN_REGION")], "src string, dst string, type string")
    rules = [(["supplier", "region"], [("supplier", "IN_NATION", "nation"), ("nation", "IN_REGION", "region")])]
    ask = lambda q: [r.id for r in knowledge.answer(q, nodes, edges, rules).collect()]
    assert ask("which supplier is in the region north") == ["s1"] and ask("which supplier is in the region south") == []
    assert ask("supplier of any region") == ["s1"] and ask("hello") == []
    assert knowledge.verdict(spark.range(7)).head().verdict == "fair" and knowledge.verdict(spark.range(0)).head().verdict == "empty"


def test_page_marker_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('lost,row\n;[1],\na,,b\n"c d",\n;[2],\n,,\n;[3],\nz\n')
    got = sorted((r.page_num, r.text, r.char_count) for r in files.page_marker_csv(spark, str(tmp_path / "p.csv")).collect())
    assert got == [(1, "a b\nc d", 7), (3, "z", 1)]
    (tmp_path / "q.csv").write_text("a,b\nc\n")
    assert files.page_marker_csv(spark, str(tmp_path / "q.csv")).collect() == []


def test_extract(spark, tmp_path):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    (tmp_path / "a.docx").write_bytes(made.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "d.xyz").write_bytes(b"?")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in files.extract(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("One & two\nthree", "done"), "b.docx": (None, "failed: BadZipFile"), "c.txt": ("한글", "done"), "d.xyz": (None, "unsupported")}


def test_json_lines_and_fallback(spark, tmp_path):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    files.write_json_lines(spark.createDataFrame([(1, "é"), (2, " ")], "id long, text string"), str(tmp_path / "j"))
    first = files.read_json_lines(spark, str(tmp_path / "j"), "id long, text string")
    second = spark.createDataFrame([(1, "no"), (2, "two")], "id long, text string")
    assert sorted((r.id, r.text, r.artifact) for r in files.first_text(docs, [first, second], "id").collect()) == [(1, "é", 0), (2, "two", 1), (3, None, None)]


def test_pages_and_requirements(spark):
    docs = spark.createDataFrame([(1, "head\n===== [PAGE 2] =====\nbody\n===== [PAGE 3] =====\n\n"), (2, "CNR-001 must do\nmore\nSFR-12 optional")], "id long, text string")
    assert [(r.id, r.page_no, r.text) for r in chunking.pages(docs, "id", "text").orderBy("id", "page_no").collect()][:2] == [(1, 1, "head"), (1, 2, "body")]
    got = {r.req_id: (r.prefix, r.boost) for r in chunking.requirements(docs, "id", "text").collect()}
    assert got == {"CNR-001": ("CNR", 1.3), "SFR-12": ("SFR", 0.7)}


def test_pack():
    text = " ".join(f"Sentence number {i} has seven words here." for i in range(200))
    made = chunking.pack(text, size=100, least=20, overlap=10)
    assert all(chunking.estimate(text[a:b]) <= 125 for _, a, b in made)
    assert made[0][1] == 0 and made[-1][2] == len(text)
    assert all(x[2] <= y[1] for x, y in zip(made, made[1:]))
    covered = "".join(text[a:b] for _, a, b in made)
    assert covered.replace(" ", "") == text.replace(" ", "")
    assert all(c.endswith(text[a:b]) for c, a, b in made)
    assert chunking.pack("") == [] and len(chunking.pack("x" * 9000)) == 1


def test_guard():
    assert graph.read_only("MATCH (a)-[:R]->(b) RETURN b")
    assert not graph.read_only("MATCH (a) DELETE a") and not graph.read_only("MATCH (a) RETURN a; MATCH (b)") and not graph.read_only("hello")
    assert graph.read_only("MATCH (a {name: 'delete'}) RETURN a")
    for call in ("CALL apoc.load.json('x') YIELD value", "CALL dbms.listConfig()", "call  gds.pageRank.stream('g')", "CALL db.labels()", "CALL `apoc`.help('x')"):
        assert not graph.read_only(f"{call} RETURN 1"), call
    assert not graph.read_only("MATCH (a) FOREACH (x IN [1] | SET a.n = x) RETURN a") and not graph.read_only("UNWIND [1] AS x RETURN x")
    assert graph.read_only("MATCH (a {callsign: 'apoc'}) RETURN a.callsign")


def test_graph_edges_and_paths(spark):
    nodes = spark.createDataFrame([(x, "t", x) for x in "abcde"], "id string, type string, label string")
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "b", "r"), ("b", "c", "r"), ("c", "zz", "r"), ("d", "c", "r")], "src string, dst string, type string")
    kept = graph.with_endpoints(edges, nodes)
    assert {r.edge_id for r in kept.collect()} == {"a->b:r", "b->c:r", "d->c:r"}
    assert [r.id for r in graph.shortest_path(kept, "a", "d").orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(kept, "a", "e").collect() == []
    assert {r.id: r.depth for r in graph.reach(kept, nodes.filter("id = 'a'"), 2).collect()} == {"a": 0, "b": 1, "c": 2}
    left, right = graph.delete_nodes(nodes, kept, ["b"])
    assert left.count() == 4 and right.count() == 1


def test_relaxation_levels(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, g string")
    assert {r.strategy for r in metadata.relaxed(rows, [F.col("g") == "x", F.col("g") == "y"], "id").collect()} == {2}
    assert [(r.id, r.strategy) for r in metadata.relaxed(rows, [F.col("g") == "x", F.col("g") == "b"], "id").collect()] == [(2, 1)]


def test_snapshots_and_stages(spark, tmp_path):
    assert upkeep.snapshot_id(date(2026, 7, 2), "web", ["snapshot_20260702_web_V1", "snapshot_20260702_web_V3", "snapshot_20260701_web_V9"]) == "snapshot_20260702_web_V4"
    calls = []

    def first(_):
        calls.append("first")
        return spark.range(5)

    def second(rows):
        calls.append("second")
        return rows.filter("id > 2")

    runner = upkeep.StageRunner(spark, str(tmp_path), [("first", first), ("second", second)])
    assert runner.run().count() == 2 and runner.run().count() == 2 and calls == ["first", "second"]
    assert runner.run(first="second").count() == 2 and calls[-1] == "second" and len(calls) == 3


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = append.follow(spark, source, events.schema, 1)
    query = append.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = sorted(map(tuple, append.windowed_counts(events).collect()))
    assert sorted(map(tuple, spark.table("counted").collect())) == want and append.sessions(events).count() > 0


def test_section_chunks(spark):
    from tessera.operators import filters

    parts = [f"{k} " + "x" * 396 for k in range(6)]
    assert [c[:1] + c[-3:] for c in filters.pack_paragraphs("\n\n".join(parts), 1400, 50, 250)] == ["0xxx", "xxxx"]
    made = filters.pack_paragraphs("\n\n".join(parts), 1400, 50, 250)
    assert made[0] == "\n\n".join(parts[:3]) and made[1] == made[0][-50:] + "\n\n" + "\n\n".join(parts[3:]) and len(made[1]) <= 1400
    assert filters.pack_paragraphs("short") == ["short"] and filters.pack_paragraphs(" \n\n ") == []
    tail = filters.pack_paragraphs("a" * 1390 + "\n\n" + "b" * 60, 1400, 0, 250)
    assert tail == ["a" * 1390, ("a" * 1390 + "\n\n" + "b" * 60)[-1400:]]
    rows = spark.createDataFrame([(1, "one\n\ntwo"), (2, None)], "id long, t string")
    assert [tuple(r) for r in filters.section_chunks(rows, ["id"], "t").collect()] == [(1, 0, "one\n\ntwo")]


def test_text_fallbacks_on_odd_rows(spark, tmp_path):
    """Blank and missing texts of the tables that count as they are, repeated and null ids: row by row as the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(2, " " * 30, "s", "en"), (1, " " * 30, "s", "en"), (5, None, "s", "en"), (7, "", "s", "en"), (4, "x", "s", None), (8, "x", "s", " "), (3, "x", "\u00a0", "en"), (6, "x", "\t", "en"), (9, "x", None, "en")]
    rows += [(3, "one", "b", "en"), (3, "one", "a", "en"), (5, "b", "s", "en"), (5, "a", "s", "en"), (5, "a", "s", "en"), (None, "lost", "s", "en"), (-3, "x", "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.QUERIES["text_fallbacks"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["text_fallbacks"]).fetchall()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, want))


def test_extracted_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    """However many documents a task has, it reads no file of all of them; a document without text is no line."""
    rows = [(i, None if i % 9 == 4 else f"text {i}\r\nmore") for i in range(1_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(building, "_folder", lambda _: f"{tmp_path}/files")
    (row,) = catalog.QUERIES["extracted_files"](spark, str(tmp_path)).collect()
    assert (row.status, row.chars) == ("done", sum(len(t) + 1 for _, t in rows if t))
    sizes = [p.read_bytes().count(b"more\n") for p in (tmp_path / "files").glob("*.txt")]
    assert sum(sizes) == sum(t is not None for _, t in rows) and max(sizes) <= 256


def test_marked_snippets_of_odd_texts(spark, tmp_path):
    """Hits at every place, among other marks and scripts, against the query's SQL; a text is searched once, not for each word shown."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    some = ["of", "OF", "(oF)", "o-f.", "of_", "off", "of가", "o", "f", "-", "é", "oé’f", "\u212aof", "\u0130of", "\U0001f600of", "of\U0001f600", "a\u00a0of", "<b>", "of\u0301", "1of", "\\", "$1"]
    texts = [None, "", " ", "of", " of ", "of of of", "-- -of- --", "x " * 40 + "of" + " y" * 40, "x\x0bof\x0cy", "x\u2028of\u2028", "\n\nOf\n\n"]
    texts += ["".join(rng.choice(some if rng.random() < 0.2 else ["w", "\U0001f600", "word,"]) + rng.choice([" ", "  ", "\n", "\t\r"]) for _ in range(rng.choice([3, 16, 40, 90]))) for _ in range(300)]
    texts += [" ".join([f"w{n}" for n in range(k)] + ["of"] + [f"v{n}" for n in range(m)]) for k in (0, 1, 14, 15, 16, 30) for m in (0, 1, 13, 14, 15, 28, 29, 30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = catalog.QUERIES["fts_marked"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, frame.collect())) == sorted(con.execute(catalog.ORACLE_SQL["fts_marked"]).fetchall())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == plan.count("Generate") * 3 and "regexp_replace" not in plan


def test_marked_pages_are_no_folder_each(spark, tmp_path, monkeypatch):
    """However many documents there are, a task writes one file of them; rows of a repeated id stay apart."""
    rows = [(i // 2 - 5, "en", f"src{i}", i) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(building, "_folder", lambda _: f"{tmp_path}/files")
    got = sorted(map(tuple, catalog.QUERIES["marked_pages"](spark, str(tmp_path)).collect()))
    assert got == sorted(x for i, lang, source, n in rows for x in ((i, 1, f"{lang} {n}"), (i, 2, f"{source}\n{i}")))
    assert 0 < sum(p.is_file() for p in (tmp_path / "files").rglob("part-*")) <= 2
