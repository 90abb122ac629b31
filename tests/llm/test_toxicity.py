"""The ordinal model on held-out rows, and its edge cases."""

import random

import numpy as np

from tessera.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    out = []
    for i in range(n):
        words, bad = rng.choices(vocab, k=rng.randint(5, 200)), rng.random() < 0.3
        for _ in range(rng.randint(2, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile", "wretch", f"grumx{rng.randint(0, 40)}"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out(spark):
    rows, other = corpus(800, 1), corpus(400, 2)
    model = toxicity.fit([t for _, t, _ in rows], [b for _, _, b in rows])
    assert model.thresholds[0] < model.thresholds[1]
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in other] + [(None, None, 1), (900, "", 1), (901, "Vile " * 50_000, 1)], "doc_id long, text string, severity int")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].toxic == b for i, _, b in other) >= 0.98 * len(other)
    assert got[None].toxic == got[900].toxic == 0 and 0 <= got[900].severity <= 2
    assert all(abs(r.severity - r.p_toxic) <= r.p_toxic for r in got.values())
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [tuple(r) for r in toxicity.score(docs, model).collect()] == [(1, 0.0, 0.0, 0)]
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_bounded_sample(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert len(toxicity.labelled(docs, labels, most=7)) == 14


def test_grades_and_likelihood():
    """All grades come out, and the fitted thresholds are those of the greatest likelihood."""
    rng = random.Random(6)
    rows = []
    for i in range(1_500):
        words, times = rng.choices([f"w{k}" for k in range(400)], k=60), rng.choice([0, 0, 0, 1, 2, 5, 6])
        bad = rng.sample(["vile", "wretch", "scoundrel", "villain", "knave", "rogue"], times)
        rows.append((" ".join(words + bad), int(times > 0), times))
    texts, toxic = [t for t, _, _ in rows], np.array([b for _, b, _ in rows], bool)
    grade = toxicity.grades(texts, toxic)
    assert [int(g) for g in grade] == [0 if not n else 2 if n >= toxicity.SEVERE_TIMES else 1 for _, _, n in rows]
    model = toxicity.fit(texts, toxic.astype(int).tolist())
    found = np.array([model.above(t) for t in texts])
    assert (((found >= 0.5).sum(1)) == grade).mean() > 0.95
    x = np.array([sum(model.weights.get(f, 0.0) for f in toxicity.features(t)) for t in texts])
    balance = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))

    def loss(a, b):
        return sum((balance * np.logaddexp(0, np.where(grade > k, t - x, x - t))).mean() for k, t in enumerate((a, b)))

    best = loss(*model.thresholds)
    assert all(loss(model.thresholds[0] + d, model.thresholds[1] + e) > best - 2e-3 for d, e in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5)))


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "Vile wretch"), (1, "Vile wretch"), (2, "fine")], "doc_id long, text string")
    got = toxicity.score(docs, toxicity.OrdinalModel({"vile": 2.0}, (2.0, 4.0))).collect()
    assert [(r.doc_id, r.toxic, r.p_toxic) for r in got if r.doc_id == 1] == [(1, 1, 0.5)] * 2  # a tie at one half is toxic
