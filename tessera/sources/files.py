"""Sources and sinks: file listings, JSON lines, page-marker CSV, text fallbacks, extractor plug-ins, vector tables."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Callable, Collection, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.chunking import marked_lines


def scan(spark: SparkSession, root: str, pattern: str = "*", depth: int | None = None) -> DataFrame:
    """``path, name, ext, relative_path, size, mtime`` of files below a folder of any store; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"  # paths come back with a scheme
    relative = F.expr(f"substring(path, locate({_quoted(folder)}, path) + {len(folder)})")
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select(
        "path", name.alias("name"), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).alias("ext"), relative.alias("relative_path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )
    return rows if depth is None else rows.filter(F.size(F.split("relative_path", "/")) <= depth)


def _quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def extension_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def path_features(files: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Group, category, section and project from the folders; a file directly below the root has none of them."""
    parts = F.split("relative_path", "/")
    depth = F.size(parts)
    known = F.create_map(*[x for k, v in sorted(categories.items()) for x in (F.lit(k), F.lit(v))]) if categories else F.create_map().cast("map<string,string>")
    first = F.regexp_replace(F.element_at(parts, 1), "^[0-9]+[. ]+", "")
    group = F.when(depth > 1, F.coalesce(F.try_element_at(known, first), first))
    project = F.element_at(F.filter(parts, lambda p: p.rlike("^[0-9]{4,8}[. ]")), 1)
    return files.select(
        "*", group.alias("category"), F.when(depth > 2, F.element_at(parts, 2)).alias("section"),
        F.when(F.size(F.filter(parts, lambda p: p.rlike("^[0-9]{4,8}[. ]"))) > 0, project).alias("project")
    )


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_manifest(rows: DataFrame, folder: str) -> None:
    """The same rows as CSV and as JSON lines."""
    rows.write.mode("overwrite").option("header", "true").csv(f"{folder}/csv")
    write_json_lines(rows, f"{folder}/jsonl")


def page_marker_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pages of CSV files whose first cell ``;[N]`` opens page N: ``path, page_num, text, char_count``.

    The non-empty cells of a row are joined by one space, rows by a line break; empty pages go.
    """
    return marked_contents(spark.read.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("path"), "value"))


def marked_contents(contents: DataFrame) -> DataFrame:
    """The same of files that are rows ``path, value`` of a table, as many small ones are best kept."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, numbers, joined = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, row in enumerate(csv.reader(io.StringIO(text.as_py() or "", newline=""))):
                    paths.append(name)
                    numbers.append(n)
                    joined.append(" ".join(c for c in map(str.strip, row) if c))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int32()), pa.array(joined, pa.string())], names=["path", "n", "cell"])

    made = marked_lines(contents.select("path", "value").mapInArrow(cells, "path string, n int, cell string"), "path", "n", "cell")
    return made.select("path", F.col("page_no").alias("page_num"), "text", "char_count")


def first_text(documents: DataFrame, artifacts: list[DataFrame], key: str | list[str], as_is: Collection[int] = ()) -> DataFrame:
    """Each document's first existing text of several tables ``key, text``, and which one it was.

    Blank texts do not exist, except in the tables that ``as_is`` numbers: there nulls and blanks count too.
    Of a document's texts in one table the least is taken. Keys may be null and documents may repeat.
    """
    keys = [key] if isinstance(key, str) else key
    blank = ~F.coalesce(F.col("text").rlike("[^\\p{Zs}]"), F.lit(False))
    every = reduce(DataFrame.unionByName, [(a if n in as_is else a.filter(~blank)).select(*keys, "text", F.lit(n).alias("_n")) for n, a in enumerate(artifacts)])
    first = F.min(F.struct("_n", F.isnull("text").alias("_null"), "text"))
    found = every.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(first.alias("_first"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    return documents.join(found, same, "left").select(*documents.columns, "_first.text", F.col("_first._n").alias("artifact"))


def decode(data: bytes, encodings: tuple[str, ...] = ("utf-8", "cp949", "euc-kr")) -> str:
    """Text by the first encoding that fits; broken bytes are replaced if none does."""
    for name in encodings:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def _office(data: bytes, part: str, paragraph: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(part, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
        pages = []
        for n in names:
            xml = z.read(n).decode("utf-8", "replace")
            lines = (html.unescape(re.sub(r"<[^>]*>", "", p)) for p in re.split(paragraph, xml))
            pages.append("\n".join(x for x in (" ".join(x.split()) for x in lines) if x))
    return "\n".join(pages) if len(pages) == 1 else "\n".join(f"===== [PAGE {k}] =====\n{p}" for k, p in enumerate(pages, 1))


def _workbook(data: bytes) -> str:
    """Sheets of a workbook as pages; the non-empty cells of a row are joined by a bar."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        texts = lambda xml: " ".join("".join(html.unescape(t) for t in re.findall(r"<t(?:\s[^>]*)?>(.*?)</t>", xml, re.S)).split())
        names = z.namelist()
        shared = [texts(s) for s in re.findall(r"<si>(.*?)</si>", z.read("xl/sharedStrings.xml").decode(), re.S)] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        pages = []
        for sheet in sheets:
            rows = []
            for row in re.findall(r"<row[^>]*>(.*?)</row>", z.read(sheet).decode(), re.S):
                cells = []
                for attributes, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S):
                    value = re.search(r"<v>(.*?)</v>", body, re.S)
                    kind = re.search(r't="(\w+)"', attributes)
                    if kind and kind[1] == "s" and value:
                        cells.append(shared[int(value[1])])
                    else:
                        cells.append(html.unescape(value[1]) if value else texts(body))
                rows.append(" | ".join(c for c in cells if c))
            pages.append("\n".join(r for r in rows if r))
    return "\n".join(pages) if len(pages) == 1 else "\n".join(f"===== [PAGE {k}] =====\n{p}" for k, p in enumerate(pages, 1))


#: Extractors by extension; more can be registered by a caller.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "txt": decode,
    "csv": decode,
    "json": decode,
    "md": decode,
    "docx": lambda d: _office(d, r"word/document\.xml", r"</w:p>"),
    "xlsx": _workbook,
    "pptx": lambda d: _office(d, r"ppt/slides/slide\d+\.xml", r"</a:p>"),
    "hwpx": lambda d: _office(d, r"Contents/section\d+\.xml", r"</hp:p>"),
}


def extract(spark: SparkSession, root: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``path, text, status``: each file by its extension's extractor; failures and unknown kinds are a status, not an error."""
    known = EXTRACTORS | (extractors or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one file at a time: texts may be large
                one, text, status = known.get(path.as_py().rsplit(".", 1)[-1].lower()), None, "unsupported"
                try:
                    if one:
                        text, status = pa.array([one(content.as_py())], pa.string()), "done"
                except Exception as why:  # a broken file must not stop the batch
                    status = f"failed: {type(why).__name__}"
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.nulls(1, pa.string()) if text is None else text, pa.array([status])], names=["path", "text", "status"])

    return files.mapInArrow(work, "path string, text string, status string")


def write_texts(rows: DataFrame, folder: str, most: int = 256) -> None:
    """Text files of one column's rows, a line break behind each; at most so many rows a file, as a file is read whole."""
    rows.write.option("maxRecordsPerFile", most).text(folder)


def write_vectors(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """The vector table; with ``partition`` one folder per category, which later filters prune."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def vector_manifest(rows: DataFrame, document: str, model: str | None = None) -> DataFrame:
    """Vectors per document, their dimension, and the model that made them where one is named."""
    made = rows.groupBy(document).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))
    return made if model is None else made.withColumn("model", F.lit(model))
