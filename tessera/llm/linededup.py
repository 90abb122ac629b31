"""Operator 8: line de-duplication by a deletion-neighbourhood join.

A line is its words (maximal runs of anything but ASCII white space); lines
without words are never touched.  Two lines match if their edit distance in
words is within the bound of the shorter one: one word inserted, deleted or
replaced where that is at most a fifth of it (``LEAST_WORDS`` words or more),
none below that.  An occurrence goes if a matching line stands earlier: smaller
document id, or same id and earlier line.  Lines are judged on the input, not on
what is left of it.

1. Equal lines collapse to their hash, with the first occurrence.
2. A one-word edit leaves the front or the back half intact.  Only distinct
   lines that share such a half with another go on, and only with the deletions
   that fall in the other half.  Their words are fetched from the texts; a bitmap
   of fixed size keeps texts without such lines out of that shuffle.
3. They emit their deletion variants as hashed keys.  Distinct lines that are
   equal without the word at the same position are one replacement apart; a line
   that equals another's variant is one insertion apart.
4. Per key and kind only the earliest occurrence matters, so a key's rows are
   reduced to three minima before they are shuffled, and a line meets one
   witness a key instead of all its partners.
5. The edit distance of a line and its witnesses is verified on their words, and
   the earliest verified witness counts.
6. Each line's occurrences after its earliest match are taken out of the texts.

Null texts count as empty.  Rows with a null id keep their text and make
nothing else go.  Rows that repeat an id count as the same place: neither makes
the other go.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, map_arrow, sha256_hex

LEAST_WORDS = 5
#: Bits of the bitmap of documents that hold candidate lines; beyond about as many documents it lets all texts pass.
BITMAP_BITS = 2**26
_BITMAP_BLOCK = 2**16
#: Kinds of variant rows: equal but for one position; a whole line; a line less one word.
REPLACED, WHOLE, SHORTENED = 0, 1, 2

_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
_powers: dict[tuple[int, int], np.ndarray] = {}


def pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, _packed``: the text's compressed bytes, for a cheaper shuffle."""
    key = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t) for t in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "_packed"])

    return map_arrow(docs.select(id_col, bytes_of(text_col).alias("_text")), work, f"`{id_col}` {key}, _packed binary")


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _is(lines: list[bytes], row: int, line: int) -> bool:
    """Whether that row is that line: rows that repeat an id may have other texts."""
    return row < len(lines) and xxhash.xxh3_64_intdigest(b" ".join(lines[row].split())) == line % 2**64


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line with words: hash, words, place and the hashes of its halves (null where they don't count)."""
    digest = xxhash.xxh3_64_intdigest
    names = ["line", "doc", "row", "halves"]
    for batch in batches:
        line, doc, row, half, sizes = [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k, one in enumerate(text.split(b"\n")):
                words = one.split()
                if not words:
                    continue
                n = len(words)
                line.append(digest(b" ".join(words)))
                doc.append(key)
                row.append(k)
                if n < LEAST_WORDS:
                    sizes.append(0)
                    continue
                shorter, longer = (n - 1) // 2, n // 2
                for q in (shorter,) if shorter == longer else (shorter, longer):
                    half.append(digest(b" ".join(words[:q]), q << 1))
                    half.append(digest(b" ".join(words[n - q :]), q << 1 | 1))
                sizes.append(2 if shorter == longer else 4)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(_signed(line)), pa.array(doc, pa.int64()), pa.array(row, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(_signed(half)))], names=names)


def _power(base: int, n: int) -> np.ndarray:
    if (found := _powers.get((base, 0))) is None or len(found) < n:
        size = max(1024, 2 * n)
        found = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASES[base], np.uint64)]), dtype=np.uint64)
        _powers[base, 0] = found
    return found[:n]


def _without(words: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    """Hashes of the sequence without each of its words, and of the whole; ``words`` are 64-bit word hashes."""
    n = len(words)
    power = _power(base, n + 1)
    terms = words * power[:n]
    upto = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    moved = np.concatenate([[np.uint64(0)], np.cumsum(words[1:] * power[: n - 1], dtype=np.uint64)])  # what follows moves one place to the front
    return upto[:-1] + (moved[-1] - moved), int(upto[-1])


def _mix(values: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = values ^ (np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def variants(words: list[bytes], front: bool, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, second hashes and kinds for a line whose intact half is ``front`` and/or ``back``."""
    n = len(words)
    one = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    two = _mix(one, 77)
    gone = np.arange(n)
    keep = (gone >= (n - 1) // 2) & front | (gone <= n // 2) & back
    short1, whole1 = _without(one, 0)
    short2, whole2 = _without(two, 1)
    short1, short2, gone = short1[keep], short2[keep], gone[keep]
    keys = np.concatenate([_mix(short1, (gone.astype(np.uint64) << np.uint64(32)) + np.uint64(n)), _mix(np.append(short1, np.uint64(0)), n - 1 + (1 << 62))])
    keys[-1] = _mix(np.array([whole1], np.uint64), n + (1 << 62))[0]
    kinds = np.repeat(np.array([REPLACED, SHORTENED, WHOLE], np.int8), [len(gone), len(gone), 1])
    second = np.concatenate([short2, short2, np.array([whole2], np.uint64)]) >> np.uint64(33)
    return keys, second, kinds


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``line, doc, row, front, back, words``: the lines' variant rows."""
    names = ["key", "second", "kind", "line", "doc", "row"]
    for batch in batches:
        if not batch.num_rows:
            continue
        front, back, words = (batch.column(k).to_pylist() for k in ("front", "back", "words"))
        parts = [variants(w.split(), f, b) for f, b, w in zip(front, back, words, strict=True)]
        sizes = [len(k) for k, _, _ in parts]
        keys, second, kinds = (np.concatenate([x[c] for x in parts]) for c in range(3))
        own = [pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in ("line", "doc", "row")]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(second.astype(np.int32)), pa.array(kinds), *own], names=names)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``doc, _packed, _todo``: the listed lines with their words."""
    kinds = {"line": pa.int64(), "doc": pa.int64(), "row": pa.int32(), "front": pa.bool_(), "back": pa.bool_(), "words": pa.binary()}
    for batch in batches:
        out = {k: [] for k in kinds}
        for doc, text, todo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = unpack(text).split(b"\n")
            for one in todo:
                if _is(lines, one["row"], one["line"]):
                    for k, v in (one | {"doc": doc, "words": b" ".join(lines[one["row"]].split())}).items():
                        out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two word sequences is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``line, doc, row, words, other`` the pairs whose words are within one edit."""
    for batch in batches:
        keep = [within_one(a.split(), b.split()) for a, b in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["line", "doc", "row"])


def _bit(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64), 5) % np.uint64(BITMAP_BITS)).astype(np.int64)


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``BITMAP_BITS`` bits in which each of the integer ids has its bit set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_BITS // 8, np.uint8)
        for batch in batches:
            at = _bit(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        blocks = bits.reshape(-1, _BITMAP_BLOCK)
        busy = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(busy.astype(np.int32)), pa.array([blocks[k].tobytes() for k in busy], pa.binary())], names=["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint8)
                found[block] = found[block] | part if block in found else part
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["block", "bits"])

    schema = "block int, bits binary"
    out = np.zeros((BITMAP_BITS // 8 // _BITMAP_BLOCK, _BITMAP_BLOCK), np.uint8)
    for block, raw in map_arrow(map_arrow(ids, mark, schema).repartition("block"), merge, schema).collect():
        out[block] = np.frombuffer(raw, np.uint8)
    return out.ravel()


def holding(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``texts(doc, _text)`` whose doc has its bit set by ``docs``: all that are wanted, and few others."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column(0).to_numpy())
            yield batch.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0, pa.bool_()))

    return texts.mapInArrow(work, "doc bigint, _text string")


def _near(firsts: DataFrame, own: DataFrame) -> DataFrame:
    """``line, witness``: the earliest place of another line within one edit, for distinct lines that have any; ``own`` holds ``doc, _text``."""
    halves = firsts.filter(F.size("halves") > 0).select("line", F.posexplode("halves").alias("side", "half")).select("line", "half", (F.col("side") % 2).alias("side"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    sides = halves.join(shared, "half").groupBy("line").agg(F.bool_or(F.col("side") == 0).alias("front"), F.bool_or(F.col("side") == 1).alias("back"))
    todo = cut(firsts.select("line", "place").join(sides, "line").select(F.col("place.doc").alias("doc"), F.struct("line", "place.row", "front", "back").alias("one")))
    per_doc = todo.groupBy("doc").agg(F.collect_list("one").alias("_todo"))
    texts = packed(holding(own, todo.select("doc")), "doc", "_text")
    words = cut(map_arrow(texts.join(per_doc, "doc").select("doc", "_packed", "_todo"), _fetched, "line bigint, doc bigint, row int, front boolean, back boolean, words binary"))
    rows = map_arrow(words, _variants, "key bigint, second int, kind tinyint, line bigint, doc bigint, row int")
    place = F.struct("doc", "row", "line")
    least = [F.min(F.when(F.col("kind") == k, place)).alias(f"m{k}") for k in (REPLACED, WHOLE, SHORTENED)]
    minima = rows.groupBy("key", "second").agg(*least, F.count("*").alias("n")).filter("n > 1").drop("n")
    witness = F.when(F.col("kind") == REPLACED, F.col(f"m{REPLACED}")).when(F.col("kind") == WHOLE, F.col(f"m{SHORTENED}")).otherwise(F.col(f"m{WHOLE}"))
    met = rows.select("key", "second", "kind", "line").join(minima, ["key", "second"]).select("line", witness.alias("w")).filter("w is not null and w.line <> line")
    pairs = met.groupBy("line", "w").agg(F.lit(1).alias("one")).select("line", "w.doc", "w.row", F.col("w.line").alias("at"))
    both = pairs.join(words.select("line", "words"), "line").join(words.select(F.col("line").alias("at"), F.col("words").alias("other")), "at")
    sure = map_arrow(both.select("line", "doc", "row", "words", "other"), _verified, "line bigint, doc bigint, row int")
    return sure.groupBy("line").agg(F.min(F.struct("doc", "row")).alias("witness"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, rows``: per document that loses any, the 0-based numbers and hashes of the lines that go; the id must be an integer."""
    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("_text"))
    lines = map_arrow(own.select("doc", bytes_of("_text").alias("_text")), _lines, "line bigint, doc bigint, row int, halves array<bigint>")
    firsts = cut(lines.groupBy("line").agg(F.min(F.struct("doc", "row")).alias("place"), F.first("halves").alias("halves"), F.count("*").alias("n")))
    near = cut(_near(firsts, own))
    marks = firsts.select("line", "place", "n").join(near, "line", "left").filter("n > 1 or witness < place")
    # read back as a table of its own, both sides of the next join are shuffled for it, and a frequent line's partition can be split
    bars = cut(marks.select("line", F.least("place", F.coalesce("witness", "place")).alias("bar")))
    gone = lines.select("line", "doc", "row").join(bars, "line").filter(F.struct("doc", "row") > F.col("bar"))
    return gone.groupBy("doc").agg(F.collect_set(F.struct("row", "line")).alias("rows"))


def _kept(text: bytes, rows: list[dict] | None) -> tuple[bytes, int]:
    """The text without the listed lines, and how many went."""
    if not rows:
        return text, 0
    lines = text.split(b"\n")
    gone = {x["row"] for x in rows if _is(lines, x["row"], x["line"])}
    return b"\n".join([x for k, x in enumerate(lines) if k not in gone]), len(gone)


def _apply(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, work, schema: str) -> DataFrame:
    texts = packed(docs, id_col, text_col)
    joined = texts.join(found.withColumnRenamed("doc", id_col), id_col, "left").select(id_col, "_packed", "rows")
    return map_arrow(joined, work, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_lines, n_removed, kept_sha256`` of every row; n_lines counts lines with words."""
    key = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = unpack(text)
                total.append(sum(bool(x.strip(b" \t\r\x0b\x0c")) for x in data.split(b"\n")))
                left, lost = _kept(data, rows)
                gone.append(lost)
                kept.append(sha256_hex(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_lines", "n_removed", "kept_sha256"])

    return _apply(docs, repeats(docs, id_col, text_col), id_col, text_col, work, f"`{id_col}` {key}, n_lines long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines taken out of ``text_col``; null texts stay null, every row and other column stays."""
    found, names = repeats(docs, id_col, text_col).select(F.col("doc").alias(id_col), F.col("rows").alias("_gone")), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("_gone").to_pylist()
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else _kept(t.encode(), g)[0].decode() if g else t for t, g in zip(batch.column(at).to_pylist(), gone, strict=True)]
            made = batch.set_column(at, text_col, pa.array(texts, pa.string()))
            yield made.select(names)

    from pyspark.sql.types import StructType

    return docs.join(found, id_col, "left").mapInArrow(work, StructType(docs.schema.fields))


REPORT_SQL = f"""
WITH raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS r FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
l AS (SELECT *, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM raw),
k AS (SELECT *, array_to_string(ws, ' ') AS k, {{'a': doc_id, 'b': r}} AS place FROM l WHERE len(ws) > 0),
f AS (SELECT k, any_value(ws) AS ws, min(place) AS f FROM k GROUP BY k),
v AS (SELECT k, f, len(ws) AS n, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS short FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM f WHERE len(ws) >= {LEAST_WORDS})),
same AS (SELECT n, i, short, min(f) AS m FROM v GROUP BY n, i, short HAVING count(*) > 1),
near AS (
  SELECT v.k, s.m FROM v JOIN same s ON s.n = v.n AND s.i = v.i AND s.short = v.short
  UNION ALL SELECT v.k, f.f FROM v JOIN f ON f.k = v.short AND len(f.ws) >= {LEAST_WORDS}
  UNION ALL SELECT f.k, v.f FROM v JOIN f ON f.k = v.short AND len(f.ws) >= {LEAST_WORDS}
  UNION ALL SELECT k, f FROM f),
bar AS (SELECT k, min(m) AS bar FROM near GROUP BY k),
gone AS (SELECT k.doc_id, k.r FROM k JOIN bar ON bar.k = k.k WHERE k.place > bar.bar),
kept AS (SELECT raw.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY raw.r) AS t FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.r = raw.r WHERE gone.r IS NULL GROUP BY raw.doc_id),
total AS (SELECT doc_id, count(*) FILTER (len(ws) > 0) AS n_lines, count(*) AS n FROM l GROUP BY doc_id)
SELECT total.doc_id, n_lines, total.n - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM total LEFT JOIN kept ON kept.doc_id = total.doc_id
"""
