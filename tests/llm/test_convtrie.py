"""Operator 12 against a trie of plain dictionaries."""

import hashlib
import random
import zlib

import pytest

convtrie = pytest.importorskip("tessera.llm.convtrie")
SCHEMA = "conv_id long, turn int, role string, text string, run string, part int"


def rebuilt(rows):
    own = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, token(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def token(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    """One row a node, from the members of each prefix."""
    whole = rebuilt(rows)
    members, ends = {}, {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids.get(p, [])) or 1
        saved = sum(below[k][1] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        below[p] = leaves, saved
    out = []
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, pieces=6):
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(pieces)
    made = convtrie.trie(frame)
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == brute(rows)
    return got


def talk(n, seed=1, words=3, longest=9):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "c" * 40][:words])) for c in range(n) for t in range(rng.randint(1, longest))]


def test_random_conversations(spark):
    check(spark, talk(120))
    check(spark, talk(60, seed=2, words=1))


def test_copies_and_a_common_first_turn(spark):
    rows = [(5 * i + 1_000, t, "user", f"t{t}") for i in range(150) for t in range(4)]
    rows += [(5 * i, t, "user", "hello" if t == 0 else f"{i} {t}") for i in range(150) for t in range(3)]
    check(spark, rows)


def test_small_runs_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "RANGE_BYTES", 600)
    monkeypatch.setattr(convtrie, "PIECE", 7)
    rows = talk(90, seed=3) + [(5 * i + 10_000, t, "user", "same") for i in range(120) for t in range(2)]
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, None, "user", None), (3, 1, None, "z"), (3, 1, None, "z"), (3, 1, "b", "z"), (-7, 0, "user", "neg"), (-5, 0, "user", "base"), (-5, 1, "user", "base2"), (-2, 4, "a", "b"), (0, 0, "a", "b")]
    check(spark, rows + talk(30, seed=9))
    check(spark, [(2**63 - 1, 0, "a", "b"), (2**63 - 3, 0, "a", "c"), (-(2**63), 0, "a", "b")])


def test_turnless(spark):
    c = next(c for c in range(1, 10_000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    got = check(spark, [(c, 0, "user", "gone")])
    assert len(got) == 1 and got[0][1] == 0 and got[0][5] == 1


def test_no_rows(spark):
    assert convtrie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert convtrie.trie(spark.createDataFrame([(None, 1, "a", "b", "c", 1)], SCHEMA)).count() == 0


def test_long_conversation_and_text(spark):
    check(spark, [(0, t, "user", f"turn {t % 50}") for t in range(1_500)] + [(10, t, "user", "é" * (200_000 if t == 1 else 2)) for t in range(9)])


def test_loser_tree_orders_and_spares_comparisons():
    rng = random.Random(6)
    word = lambda: bytes([rng.randint(0, 2)]) * convtrie.WIDTH
    rows = [(b"".join(word() for _ in range(rng.randint(0, 12))), i, b"") for i in range(3_000)]
    for k in (1, 2, 3, 7, 16):
        cut = [convtrie.sorted_run(rows[i::k]) for i in range(k)]
        tree = convtrie.LoserTree(cut)
        merged = list(tree)
        assert [r[:2] for r, _ in merged] == sorted((p, i) for p, i, _ in rows)
        for (a, _), (b, lcp) in zip(merged, merged[1:], strict=False):
            assert lcp == convtrie.shared(a[0], b[0])
        matches = len(rows) * max(1, (k - 1).bit_length())
        assert tree.compared < 0.75 * matches or k == 1


def test_query(spark):
    from tessera.llm import registry

    sf = "/root/testdata/sf0.01"
    rows = list(map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert sorted(map(tuple, registry.QUERIES["op12_conversation_trie"](spark, sf).collect()), key=str) == brute(rows)


def test_twin(spark):
    import duckdb

    from tessera.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    result = con.execute(registry.ORACLE_SQL["op12_conversation_trie"])
    made = registry.QUERIES["op12_conversation_trie"](spark, sf)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(made.columns)
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r)) for r in made.select(names).collect())
