"""Terms of a dictionary in texts: all forms at once by one automaton, and the graph layers that follow from them.

A dictionary is a table of ``layer, canonical, form`` and, where terms have an
order among them, ``parent``.  Its forms are sent to the workers as one
Aho-Corasick automaton, so that a text is read once however many forms there are.
What is sent is bounded: a dictionary of more than ``MOST_BYTES`` is dealt into
shards by the hash of the form, and each shard reads the texts in turn.

Forms match anywhere in the lower-cased text, or as whole words only.  A term is
found where any of its forms is; its own name is a form too.  Null texts hold
nothing, empty and null forms match nothing, repeated forms count once.  A form
may stand for several terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of forms in an automaton that is sent to the workers.
MOST_BYTES = 8 << 20
#: Texts that are matched at once.
TEXTS_AT_ONCE = 1_000

_made: dict[str, object] = {}


def forms_of(dictionary: DataFrame) -> DataFrame:
    """``layer, canonical, form``: every form in lower case, a term's own name among them."""
    own = dictionary.select("layer", "canonical", F.lower("canonical").alias("form"))
    other = dictionary.select("layer", "canonical", F.lower("form").alias("form"))
    return own.unionByName(other).filter("form <> ''").distinct()


def _automaton(sent: Broadcast, key: str):
    """The worker's automaton of one broadcast; only the last one is kept."""
    if key not in _made:
        import ahocorasick

        _made.clear()
        automaton = ahocorasick.Automaton()
        for form, terms in sent.value.items():
            automaton.add_word(form, (len(form), terms))
        automaton.make_automaton()
        _made[key] = automaton
    return _made[key]


def _whole(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def matches(text: str, automaton, whole_words: bool) -> dict[int, tuple[int, int]]:
    """Number of places and the first of them, for each term of the automaton that is in a text."""
    found: dict[int, tuple[int, int]] = {}
    for last, (size, terms) in automaton.iter(text):
        start = last - size + 1
        if whole_words and not _whole(text, start, last + 1):
            continue
        for term in terms:
            n, first = found.get(term, (0, start))
            found[term] = n + 1, min(first, start)
    return found


def terms(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_words: bool = False) -> DataFrame:
    """``id, layer, canonical, n, first``: each term that is in a text, at how many places, and the first (from 0)."""
    spark = docs.sparkSession
    forms = forms_of(dictionary)
    size = forms.agg(F.sum(F.octet_length("form") + F.octet_length("canonical") + 16)).head()[0] or 0
    shards = max(1, -(-size // MOST_BYTES))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("_t")).filter("_t <> ''")
    made = None
    for shard in range(shards):
        own = forms.filter(F.pmod(F.xxhash64("form"), F.lit(shards)) == shard) if shards > 1 else forms
        listed = own.collect()  # at most MOST_BYTES of them
        names = sorted({(r.layer, r.canonical) for r in listed})
        number = {name: i for i, name in enumerate(names)}
        by_form: dict[str, list[int]] = {}
        for r in listed:
            by_form.setdefault(r.form, []).append(number[r.layer, r.canonical])
        if not names:
            continue
        found = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(by_form), spark.sparkContext.broadcast(names), whole_words), f"id {kind}, layer string, canonical string, n long, first long")
        made = found if made is None else made.unionByName(found)
    if made is None:
        return rows.select("id", F.lit("").alias("layer"), F.lit("").alias("canonical"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first")).limit(0)
    # forms of one term may lie in several shards
    return made if shards == 1 else made.groupBy("id", "layer", "canonical").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _matcher(forms: Broadcast, names: Broadcast, whole_words: bool):
    key = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(forms, key), names.value
        layers, canonicals = pa.array([n[0] for n in known], pa.string()), pa.array([n[1] for n in known], pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                rows, term, n, first = [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for k, (count, start) in matches(text, automaton, whole_words).items():
                        rows.append(i)
                        term.append(k)
                        n.append(count)
                        first.append(start)
                which = pa.array(term, pa.int64())
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), layers.take(which), canonicals.take(which), pa.array(n, pa.int64()), pa.array(first, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "layer", "canonical", "n", "first"])

    return work


def layers(found: DataFrame, dictionary: DataFrame, relations: Mapping[str, str], parents: str = "PARENT_TECH", of: str = "technology") -> tuple[DataFrame, DataFrame]:
    """``nodes(id, type, label)`` and ``edges(src, dst, type, n)`` of found terms.

    A document has an edge to each of its terms, by the relation of the term's layer.
    Terms of the layer ``of`` have an edge from their parent; parents of found terms are
    nodes even where no text holds them, so that both ends of every edge exist.
    """
    node = lambda layer, name: F.concat(layer, F.lit(":"), F.lower(name))
    relation = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    own = F.concat(F.lit("document:"), F.col("id").cast("string"))
    held = found.filter(F.col("layer").isin(*relations)).select(own.alias("src"), node(F.col("layer"), F.col("canonical")).alias("dst"), F.element_at(relation, F.col("layer")).alias("type"), "n")
    used = found.select("layer", "canonical").distinct()
    above = dictionary.filter((F.col("layer") == of) & F.col("parent").isNotNull()).select("layer", "canonical", "parent").distinct()
    up = above.join(used, ["layer", "canonical"], "left_semi").filter(F.lower("parent") != F.lower("canonical"))
    edges = held.unionByName(
        up.select(
            node(F.col("layer"), F.col("parent")).alias("src"), node(F.col("layer"), F.col("canonical")).alias("dst"), F.lit(parents).alias("type"),
            F.lit(1).cast("long").alias("n")
        )
    )
    named = used.unionByName(up.select("layer", F.col("parent").alias("canonical")))
    values = named.groupBy(node(F.col("layer"), F.col("canonical")).alias("id")).agg(F.min("layer").alias("type"), F.min("canonical").alias("label"))
    docs = found.select(own.alias("id"), F.lit("document").alias("type"), F.col("id").cast("string").alias("label")).distinct()
    return docs.unionByName(values), edges.groupBy("src", "dst", "type").agg(F.sum("n").alias("n"))
