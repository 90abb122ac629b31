"""The pipeline's stages, one after the other, against plain Python on a small corpus."""

import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(800)]
    folder = str(tmp_path_factory.mktemp("sf"))
    prose = lambda n: "\n".join(" ".join(rng.choices(vocab, k=20)) for _ in range(n))
    item = " ".join(rng.choices(vocab, k=25))
    docs = [(i, prose(6)) for i in range(200)]
    for i in range(0, 60):
        docs[i] = (i, docs[i][1] + "\nyou vile wretch vile")
    docs += [(300, None), (301, ""), (302, docs[100][1]), (303, prose(2) + "\n" + item + " end"), (304, prose(3)), (304, prose(3))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 60)) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run(spark, sf_dir):
    kinds = ("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert tuple(docs.columns) == kinds, name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    # the copy, the null and the empty text fall together once lines are gone
    assert set(got) == {*range(60, 200), 300, 304}
    from tokenizers import Tokenizer

    import public_tokenizers

    bpe = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    first = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id = 60").first().text
    ids = bpe.encode(first, add_special_tokens=False).ids
    assert list(got[60].ids) == ids and got[60].n_tokens == len(ids)
    assert got[60].decoded_sha256 == hashlib.sha256(bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stage_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(60, 200)) | {300, 301, 302, 303, 304}
    assert corpus_pipeline.drop_contaminated(spark, docs, sf_dir).filter("doc_id = 303").count() == 0
    assert corpus_pipeline.drop_near_copies(spark, docs, sf_dir).filter("doc_id = 302").count() == 0
    assert corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).filter("doc_id = 302").first().text == ""


def test_nulls_and_empty_tables(spark, sf_dir):
    """Rows that are null throughout pass every stage; empty tables give empty results; other columns stay."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, line string, rows int, fp string"
    docs = spark.createDataFrame([(None, None, None, None, None, None, None, None), (None, "only here", None, None, None, None, None, None), (9_000, None, None, None, None, "x", 1, "f")], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame, n in ((docs, 3), (docs.limit(0), 0)):
            made = stage(spark, frame, sf_dir) if name != "toxicity" else corpus_pipeline.toxicity.clean(frame, corpus_pipeline.toxicity.OrdinalModel({"vile": 9.0}, (1.0, 2.0)))
            assert made.count() == n and set(made.columns) == set(docs.columns), name
    assert corpus_pipeline.encode(spark, docs, sf_dir).filter("n_tokens = 0").count() == 2
