"""Counts and base scores against brute force; the model's gradients, masks and normalisation."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm

PATH = public_tokenizers.path("word_bpe_49k.json")


def make_rows():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60))).title() + f" only{i}") for i in range(60)]
    return rows + [(None, None), (100, ""), (101, "ÄÖ \x00 ä"), (5, rows[5][1]), (5, rows[5][1]), (5, "other text"), (102, "z" * 50_000), (103, "w1 " * 30_000)]


@pytest.mark.parametrize("frequent", [400_000, 10])
def test_base(spark, frequent):
    rows = make_rows()
    tokens = [[*bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split(), None] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), h, t in zip(rows, held, tokens))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = lm.score(docs, PATH, steps=5, frequent=frequent).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({round(r.score, 3) for r in got if r.doc_id == 5}) == 2


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.fixture(scope="module")
def pieces():
    return lm.Pieces(PATH)


def test_pieces_determine_words(pieces):
    names = {n: p for p, n in pieces.bpe.get_vocab().items()} if hasattr(pieces.bpe, "get_vocab") else None
    words = ["hello".encode(), "ñandú".encode(), b"\x00\x01", bytes(range(128, 160)), b"a</w>b"]
    ids = pieces.ids(words)
    assert ids[0] == ids[-1] == pieces.end and len({pieces.ids([w]).tobytes() for w in words}) == len(words)
    assert names is None or len(names) == pieces.size - 1


def test_ids_give_the_words_back(pieces):
    rng = random.Random(2)
    words = [bytes(b for b in rng.choices(range(256), k=rng.randint(1, 12)) if b != 32 and not 9 <= b <= 13 and not 65 <= b <= 90) or b"x" for _ in range(5_000)]
    words += [b"</w>", b"a</w>", b"z" * 5_000, *words[:100]]
    ids = pieces.ids(words)
    assert pieces.words(ids) == words and (pieces.ids(words) == ids).all()
    assert pieces.ids([]).tolist() == [pieces.end] * 2 and pieces.words(pieces.ids([])) == []
    # new words are split together: as each would be alone
    alone = [t.id for w in words for t in pieces.bpe.tokenize("".join(pieces.letters[b] for b in w))]
    assert ids[1:-1].tolist() == alone


def test_a_small_memo_forgets_and_splits_again(pieces):
    words = [b"a%d" % i for i in range(300)]
    want, held = pieces.ids(words), pieces.memo
    pieces.memo = lm.Remembered(held.answer, 20)
    try:
        assert all((pieces.ids(words) == want).all() and len(pieces.memo) <= 20 for _ in range(2))
        assert b"".join(map(pieces.__getitem__, words)) == want[1:-1].astype(np.uint16).tobytes() and len(pieces.memo) <= 20
    finally:
        pieces.memo = held


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = [(i, f"some words of text {i} " * 20) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = lm.score(docs.withColumn("text", F.udf(seen, "string")("text")), PATH, steps=1).collect()
    assert len(got) == len(rows) and read.value == len(rows)


def test_scores_do_not_depend_on_the_blocks_at_hand(pieces):
    rng = np.random.RandomState(7)
    texts = [rng.randint(0, pieces.size, n) for n in (40_000, 3, 700)]
    table = np.zeros((pieces.size, pieces.size), np.float32)
    np.add.at(table, (texts[0][1:], texts[0][:-1]), 1)
    model = lm.AttentionModel(pieces.size, table)
    inputs, targets, scored, alone = (np.concatenate(x) for x in zip(*[lm.windows(t, pieces.end) for t in texts]))
    assert len(inputs) > lm.HELD_BLOCKS
    found = model.log_probabilities(inputs, targets, alone)
    few = np.concatenate([model.log_probabilities(inputs[at : at + 7], targets[at : at + 7], alone[at : at + 7]) for at in range(0, len(inputs), 7)])
    assert np.abs(found - few).max() < 1e-4
    bounds = np.cumsum([0, *[len(lm.windows(t, pieces.end)[0]) for t in texts]])
    want = [(found * scored)[a:b].sum() / math.log(10) for a, b in zip(bounds, bounds[1:])]
    assert np.allclose(lm.Scorer(model, pieces.end).log10(texts), want, rtol=1e-5)


def test_model(pieces):
    rng = np.random.RandomState(0)
    texts = [pieces.ids(b" ".join(rng.choice([b"alpha", b"beta", b"gamma"], 40)).split()) for _ in range(30)]
    model = lm.AttentionModel(pieces.size)
    # analytic gradients against differences
    made = [x[:3] for x in lm.windows(texts[0], pieces.end)]
    model.p = {n: a.astype(np.float64) for n, a in model.p.items()}
    _, slopes = model._gradients(*made)
    for name, g in slopes.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.p[name][at]
        sides = []
        for step in (1e-5, -1e-5):
            model.p[name][at] = old + step
            sides.append(model._gradients(*made)[0])
        model.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-5 - g[at]) < 1e-5, name
    model.p = {n: a.astype(np.float32) for n, a in model.p.items()}
    # every id is scored once, and the probabilities of all ids at a place add up to one
    assert sum(int(lm.windows(t, pieces.end)[2].sum()) for t in texts) == sum(len(t) - 1 for t in texts)
    inputs, targets, _, alone = (x[:1] for x in lm.windows(texts[0], pieces.end))
    total = np.zeros(targets.shape)
    for i in range(pieces.size):
        total += np.exp(model.log_probabilities(inputs, np.full_like(targets, i), alone))
    assert np.abs(total - 1).max() < 1e-3
    # causal: a later id changes nothing before it
    changed = inputs.copy()
    changed[0, -1] = (changed[0, -1] + 1) % pieces.size
    model.tables = None
    assert np.allclose(model.hidden(inputs, alone)[0, :-1], model.hidden(changed, alone)[0, :-1])
    losses = model.fit(texts, pieces.end, 60)
    assert np.mean(losses[-5:]) < 0.5 * np.mean(losses[:5])


def test_learns_from_all_texts(spark, pieces):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=30))) for i in range(2_600)]
    long = next(i for i in range(5_000, 6_000) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows.append((long, "zebra quagga okapi " * 4_000))
    probe = next(i for i in range(6_000, 7_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows.append((probe, "zebra quagga okapi " * 10))
    own = [pieces.ids(t.encode().split()) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(own) > 2_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = docs.filter(~lm.held_out("doc_id")).select(lm.bytes_of("text").alias("_text"))
    want = np.zeros((pieces.size, pieces.size))
    for t in own:
        np.add.at(want, (t[1:], t[:-1]), 1)
    counts = lm.corpus_counts(docs.filter(~lm.held_out("doc_id")), PATH, pieces.size)
    assert (lm.neighbours(counts, pieces.size) == want).all()
    # every block of every training text is learned from
    model = lm.AttentionModel(pieces.size)
    assert lm.fit_round(texts, PATH, model, 1, lambda _: 1.0, 0, 2) == sum(len(lm.windows(t, pieces.end)[0]) for t in own)
    # what only a long text teaches is known; several tasks and rounds
    score = lambda d: lm.score(d, PATH, steps=20).filter(f"doc_id = {probe}").head().score
    assert score(docs) > score(docs.filter(f"doc_id <> {long}")) + 10


def test_beats_the_base_on_held_out_words(pieces):
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    split = [(zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2, (r["text"] or "").encode().lower().split()) for r in rows]
    counts = Counter(w for held, words in split if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    own = [pieces.ids(words) for held, words in split if not held]
    table = np.zeros((pieces.size, pieces.size), np.float32)
    for t in own:
        np.add.at(table, (t[1:], t[:-1]), 1)
    model, rng = lm.AttentionModel(pieces.size, table), np.random.RandomState(0)
    model.learn((b for _ in range(4) for b in lm.batches_of(own, pieces.end, rng)), lambda step: 1 - 0.9 * min(1, step / 1_000))
    base, found = [], []
    for held, words in split:
        if held and words:
            inputs, targets, _, alone = lm.windows(pieces.ids(words), pieces.end)
            logs = np.cumsum(np.append(0, model.log_probabilities(inputs, targets, alone).ravel().astype(float) / math.log(10)))
            ends = np.cumsum([0, *[len(pieces[w]) // 2 for w in words]])
            base += [(w in counts, math.log10((counts[w] + 1) / (n + v + 1))) for w in words]
            found += (logs[ends[1:]] - logs[ends[:-1]]).tolist()
    known = np.array([k for k, _ in base])
    base, found = np.array([b for _, b in base]), np.array(found)
    assert found[known].mean() > base[known].mean() + 0.2
    assert found.mean() > base.mean() - 0.02  # though the base gives every unseen word the same share
