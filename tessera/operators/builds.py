"""How far a collection is built, what differs between its builds, and what its questions ask for."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_states(rows: DataFrame, group: str, stages: Mapping[str, Column], optional: Collection[str] = ()) -> DataFrame:
    """``group, stage, complete, total, state`` of every stage, whose condition says that a row has passed it.

    A stage is ready if all rows have, missing if none has, partial else; an optional one that no row has is empty.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in stages.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("complete"), F.lit(n in optional).alias("optional")) for n in stages]))
    made = counts.select(group, "total", each.alias("s")).select(group, "s.stage", "s.complete", "total", "s.optional")
    state = F.when(F.col("complete") >= F.col("total"), "ready").when(F.col("complete") > 0, "partial").when(F.col("optional"), "empty").otherwise("missing")
    return made.select(group, "stage", "complete", "total", state.alias("state"))


def build_state(states: DataFrame, group: str) -> DataFrame:
    """``group, ready, partial, missing, first_open``: how many stages are where, and the first in order of ``stage`` that is not ready."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.groupBy(group).agg(n("ready"), n("partial"), n("missing"), F.min(F.when(~F.col("state").isin("ready", "empty"), F.col("stage"))).alias("first_open"))


def compare_snapshots(sizes: DataFrame, key: str, one: str, two: str, measures: Sequence[str]) -> DataFrame:
    """``measure, one, two, diff, percent`` of two snapshots of a table of sizes; a snapshot that is not there has nulls."""
    both = sizes.filter(F.col(key).isin(one, two))
    pick = lambda m, k: F.max(F.when(F.col(key) == k, F.col(m).cast("double")))
    row = both.agg(F.array(*[F.struct(F.lit(m).alias("measure"), pick(m, one).alias("one"), pick(m, two).alias("two")) for m in measures]).alias("m"))
    diff = F.col("two") - F.col("one")
    return row.select(F.explode("m").alias("m")).select("m.*").select("measure", "one", "two", diff.alias("diff"), F.when(F.col("one") != 0, F.round(100 * diff / F.col("one"), 2)).alias("percent"))


def head_edges(rows: DataFrame, group: str, kind: str, head: str, id_col: str) -> DataFrame:
    """``group, src, dst``: an edge from the first document of a kind in each group to every other one; groups without it have none."""
    first = rows.filter((F.col(kind) == head) & F.col(group).isNotNull()).groupBy(group).agg(F.min(id_col).alias("src"))
    return rows.join(first, group).filter(F.col(id_col) != F.col("src")).select(group, "src", F.col(id_col).alias("dst"))


def projects_with(nodes: DataFrame, edges: DataFrame, names: Mapping[str, str], wanted: str, relation: str, year: str) -> DataFrame:
    """Projects with an edge of a relation to a value that is called ``wanted``, by any of its names, the latest first.

    ``names`` says what other names are called; without an entry the name itself is looked for.
    """
    called = {k.strip().lower(): v for k, v in names.items()}.get(wanted.strip().lower(), wanted)
    value = nodes.filter(F.lower("label") == called.lower()).select(F.col("id").alias("dst"))
    linked = edges.filter(F.col("type") == relation).join(value, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return nodes.join(linked, "id").orderBy(F.desc_nulls_last(year), "id")


Patterns = Sequence[tuple[str, str]]


def first_of(text: Column, patterns: Patterns) -> Column:
    """The name of the first pattern that is in a text, whatever the case; null if none is."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), name) for name, p in patterns], F.lit(None).cast("string"))


def compound_question(text: Column, kinds: Patterns, projects: Patterns, organisations: Sequence[str], relation: str) -> dict[str, Column]:
    """What a question asks for: ``organisation, project_type, source_kind, target_kind``.

    ``relation`` has two groups, what is named and what is wanted of it; without it the whole question may name what is wanted.
    """
    text = F.coalesce(text, F.lit(""))
    related = text.rlike(f"(?i){relation}")
    part = lambda n: F.regexp_extract(text, f"(?i){relation}", n)
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in organisations], F.lit(None).cast("string"))
    return {
        "organisation": found,
        "project_type": first_of(text, projects),
        "source_kind": F.when(related, first_of(part(1), kinds)),
        "target_kind": first_of(F.when(related, part(2)).otherwise(text), kinds),
    }


Hint = tuple[str, Sequence[str], str, Sequence[str]]


def question_hints(text: Column, rules: Sequence[Hint], generic: Collection[str], extra: Sequence[str] = (), most: int = 8) -> tuple[Column, Column]:
    """Hints as a map, and the terms that follow from them, at most ``most``.

    A rule is a hint's name, words that all have to be in the question (blanks do not
    count), its value and the terms it adds; of the rules of one hint the first that holds
    counts.  ``extra`` words are terms where they stand; generic terms and single letters are none.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\r\\n]+", "")
    has = lambda words: F.forall(F.array(*[F.lit(w.lower().replace(" ", "")) for w in words]), lambda w: F.contains(plain, w))
    names = list(dict.fromkeys(name for name, *_ in rules))
    none = F.array().cast("array<string>")
    values, terms = {}, []
    for name in names:
        own = [(has(words), value, added) for n, words, value, added in rules if n == name]
        values[name] = F.coalesce(*[F.when(holds, value) for holds, value, _ in own])
        terms.append(F.coalesce(*[F.when(holds, F.array(*[F.lit(t) for t in added]).cast("array<string>")) for holds, _, added in own], none))
    terms.append(F.filter(F.array(*[F.lit(w) for w in extra]).cast("array<string>"), lambda w: F.contains(plain, F.lower(w))))
    flat = F.transform(F.concat(*terms), lambda t: F.regexp_replace(F.lower(t), " ", ""))
    kept = F.filter(F.array_distinct(flat), lambda t: (F.length(t) >= 2) & ~t.isin(*generic))
    hints = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in values.items()]), lambda e: e.v.isNotNull()))
    return hints, F.slice(kept, 1, most)


#: Fixed values of the generator behind the stand-in embedding.
FACTOR, STEP, MODULUS = 1_103_515_245, 12_345, 2**31


def stand_in_vector(text: Column, dims: int) -> Column:
    """A unit vector that follows from a text's SHA-256 alone: a linear congruential sequence from its first eight digits, within the row."""
    seed = F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    step = lambda acc: F.pmod(F.element_at(acc, -1) * FACTOR + STEP, F.lit(MODULUS))
    states = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(dims)), F.array(seed), lambda acc, _: F.concat(acc, F.array(step(acc)))), 2, dims)
    values = F.transform(states, lambda s: s / F.lit(float(MODULUS - 1)) * 2 - 1)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(values), lambda v: F.transform(v, lambda x: x / F.when(norm(v) == 0, 1.0).otherwise(norm(v))))[0]


def late_pooled(docs: DataFrame, id_col: str, text_col: str, spans: Column, dims: int, context: float = 0.35) -> DataFrame:
    """``id, chunk_index, dim, value``: each span's mean of its tokens' vectors, mixed with the whole text's by ``context``.

    Tokens are what white space parts, embedded once a text with the vectors above;
    ``spans`` is an array of (a, b) from 0.  A span without a token has the whole text's mean.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("([ \\t\\r\\n]*)([^ \\t\\r\\n]+)"), 0)
    ends = F.aggregate(words, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(w))))
    rows = docs.select(id_col, spans.alias("_s"), words.alias("_w"), ends.alias("_e"))
    tokens = rows.select(
        id_col, "_s",
        F.posexplode(F.transform("_w", lambda w, i: F.struct(F.ltrim(F.regexp_replace(w, "[\\t\\r\\n]", " ")).alias("word"), F.element_at("_e", i + 2).alias("b")))).alias("n", "t")
    )
    placed = tokens.select(id_col, "_s", "n", (F.col("t.b") - F.length("t.word")).alias("a"), F.col("t.b").alias("b"), F.posexplode(stand_in_vector(F.col("t.word"), dims)).alias("dim", "x"))
    whole = placed.groupBy(id_col, "dim").agg(F.avg("x").alias("whole"))
    chunks = docs.select(id_col, F.posexplode(spans).alias("chunk_index", "s"))
    inside = placed.select(id_col, "a", "b", "dim", "x").join(chunks, id_col).filter((F.col("a") < F.col("s.b")) & (F.col("b") > F.col("s.a")))
    own = inside.groupBy(id_col, "chunk_index", "dim").agg(F.avg("x").alias("own"))
    every = chunks.select(id_col, "chunk_index").join(whole, id_col).join(own, [id_col, "chunk_index", "dim"], "left")
    return every.select(id_col, "chunk_index", "dim", F.coalesce((1 - context) * F.col("own") + context * F.col("whole"), F.col("whole")).alias("value"))
