"""Embedding plug-ins, late chunks, typo rules and the tool registry."""

import numpy as np
import pytest

from tessera.operators import embedding, routing, tools


def test_stand_in_and_embed(spark):
    one = embedding.stand_in(8)
    a, b = one(["x", "y"]), one(["x"])
    assert np.allclose(a[0], b[0]) and not np.allclose(a[0], a[1]) and np.allclose((a * a).sum(1), 1)
    got = embedding.embed(spark.createDataFrame([(1, "x"), (2, None)], "id long, t string"), "id", "t", one).collect()
    assert np.allclose({r.id: r.embedding for r in got}[1], a[0], atol=1e-6)


def test_late_chunks(spark):
    encoder = embedding.hashed_tokens(4)
    text = "one two three"
    spans, matrix = encoder(text)
    assert [text[a:b] for a, b in spans] == ["one", "two", "three"]
    made = embedding.pooled_spans(text, [(0, 7), (8, 13), (13, 13)], encoder)
    assert np.allclose(made[0], matrix[:2].mean(0)) and np.allclose(made[1], matrix[2]) and np.allclose(made[2], matrix.mean(0))
    rows = spark.createDataFrame([(1, text, [(0, 7), (8, 13)]), (2, None, [(0, 1)])], "id long, t string, s array<struct<a:int,b:int>>")
    got = embedding.late_chunks(rows, "id", "t", "s", encoder, 0.0).orderBy("id", "chunk_index").collect()
    assert np.allclose(got[0].embedding, made[0], atol=1e-6) and len(got) == 3


def test_typo_rules():
    assert routing.parse_typo_rules("a→b\n\nplain\n c → d \n→x") == [("a", "b"), ("c", "d")]


def test_tools(spark):
    registry = tools.ToolRegistry()

    @registry.register("add", "adds", {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]})
    def add(x):
        return x + 1

    assert registry.execute("add", x=1) == 2 and registry.schemas()[0]["function"]["name"] == "add"
    with pytest.raises(TypeError):
        registry.execute("add")
    with pytest.raises(KeyError):
        registry.execute("sub")
    with pytest.raises(ValueError):
        registry.register("add", "", {})(add)
    everything = tools.default_tools(spark, "/root/testdata/sf0.001")
    assert everything.execute("status_counts").count() == 4
