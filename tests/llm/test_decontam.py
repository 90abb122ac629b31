"""Spaced-seed decontamination against brute force and its SQL twin."""

import random
from itertools import combinations

from tessera.llm import decontam


def test_masks_hit_every_window():
    """Any window with the allowed substitutions keeps a place where a mask's positions all agree."""
    for bad in combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.LEAST_EQUAL):
        assert any(not set(bad) & {at + k for k in mask} for mask in decontam.MASKS for at in range(decontam.WINDOW - mask[-1]))


def slow(text, item):
    a, b = (text or "").lower().encode().split(), (item or "").lower().encode().split()
    for d in range(-len(b), len(a)):
        same = [k for k in range(len(b)) if 0 <= k + d < len(a) and a[k + d] == b[k]]
        if len(b) >= 15 and any(y - x < 15 for x, y in zip(same, same[11:])):
            return True
        if 0 < len(b) < 15 and len(same) == len(b):
            return True
    return False


def fixture():
    rng = random.Random(8)
    vocab = [f"t{i}" for i in range(300)] + ["the", "of"] * 40
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([5, 14, 15, 16, 30, 45])))) for k in range(12)]
    items += [(None, items[4][1]), (90, None), (91, ""), (92, items[5][1]), (93, "t1 t2"), (94, "the of the")]
    docs = [(1, None), (2, ""), (3, "the of " * 500), (None, items[5][1]), (200, "x " * 40_000 + items[6][1]), (200, "x " * 40_000 + items[6][1]), (201, "T1  t2")]
    for i in range(4, 90):
        words = rng.choices(vocab, k=rng.randint(0, 80))
        part = rng.choice(items[:12])[1].split()
        lo = rng.randint(0, 4)
        part = part[lo : len(part) - rng.randint(0, 4)]
        for _ in range(rng.randint(0, 5) if part else 0):
            part[rng.randrange(len(part))] = "odd"
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + part + words[at:]).title()))
    return docs, items


def test_report(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: ",".join(str(k) for k, x in sorted((k, x) for k, x in items if k is not None and slow(t, x))) for i, t in docs if i is not None}
    got = {r.doc_id: r.item_ids for r in decontam.report(frame, bench).collect() if r.doc_id is not None}
    assert any(want.values()) and got == want
    assert {r.doc_id for r in decontam.clean(frame, bench).collect()} == {None} | {i for i, w in want.items() if not w}


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r) for r in decontam.report(docs, items.limit(0)).collect()] == [(1, False, 0, "")]
    assert decontam.report(docs.limit(0), items).collect() == []
