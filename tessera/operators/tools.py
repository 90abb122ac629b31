"""A registry of named tools: operators behind a name, a description and a parameter schema."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import graph, linkage, metadata, ranking


#: Names of argument types in a schema.
_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean"}


@dataclass
class Tool:
    name: str
    description: str
    parameters: dict[str, Any]
    handler: Callable[..., Any]


@dataclass
class ToolRegistry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, name: str, description: str, parameters: dict[str, Any]) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        """Decorator; a name can be taken once."""

        def add(handler: Callable[..., Any]) -> Callable[..., Any]:
            if name in self.tools:
                raise ValueError(f"tool {name!r} is registered already")
            self.tools[name] = Tool(name, description, parameters, handler)
            return handler

        return add

    def add(self, handler: Callable[..., Any]) -> Callable[..., Any]:
        """Registers a function under its own name: the first line of its docstring describes it, its signature gives the schema."""
        kinds, given = get_type_hints(handler), inspect.signature(handler).parameters
        properties = {n: {"type": _KINDS[kinds[n]]} | ({} if p.default is p.empty else {"default": p.default}) for n, p in given.items()}
        required = [n for n, p in given.items() if p.default is p.empty]
        return self.register(handler.__name__, (handler.__doc__ or handler.__name__).strip().splitlines()[0], {"type": "object", "properties": properties, "required": required})(handler)

    def execute(self, name: str, **arguments: Any) -> Any:
        """Runs a tool; unknown names and missing required arguments are errors."""
        if name not in self.tools:
            raise KeyError(f"no tool {name!r}; there are {sorted(self.tools)}")
        tool = self.tools[name]
        missing = [p for p in tool.parameters.get("required", []) if p not in arguments]
        if missing:
            raise TypeError(f"tool {name!r} needs {missing}")
        return tool.handler(**arguments)

    def schemas(self) -> list[dict[str, Any]]:
        """Function schemas, in the order of registration."""
        return [{"type": "function", "function": {"name": t.name, "description": t.description, "parameters": t.parameters}} for t in self.tools.values()]


def default_tools(spark: SparkSession, sf_dir: str) -> ToolRegistry:
    """The engine's named queries as tools that return DataFrames."""
    from ..plans import catalog

    registry = ToolRegistry()
    for name, query in sorted(catalog.QUERIES.items()):
        registry.register(name, (query.__doc__ or name.replace("_", " ")).strip().splitlines()[0], {"type": "object", "properties": {}, "required": []})(lambda q=query: q(spark, sf_dir))
    return registry


def collection_tools(tables: dict[str, DataFrame], nodes: DataFrame, edges: DataFrame) -> ToolRegistry:
    """What an assistant may ask of a collection; every tool returns a DataFrame.

    ``tables`` has ``documents`` (doc_id, text, lang, source, n_chars) and others by name;
    nodes and edges are the collection's graph.  ``all`` as a category is no condition.
    """
    registry = ToolRegistry()
    docs = tables["documents"]

    def within(category: str) -> DataFrame:
        return docs if category == "all" else docs.filter(F.col("lang") == category)

    def named(dataset: str) -> DataFrame:
        if dataset not in tables:
            raise KeyError(f"no dataset {dataset!r}; there are {sorted(tables)}")
        return tables[dataset]

    @registry.add
    def search_documents(query: str, category: str = "all", top_k: int = 10) -> DataFrame:
        """The documents that match the words of a question best."""
        words = docs.sparkSession.range(1).select(F.array_distinct(tokens(F.lit(query), 2)).alias("w")).head()["w"]
        if not words:
            return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        return ranking.bm25(within(category), words).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(top_k)

    @registry.add
    def query_graph_relations(entity: str, relation_type: str = "all", depth: int = 2) -> DataFrame:
        """What is within some edges of the nodes that are called so."""
        seeds = nodes.filter(F.lower("label") == entity.strip().lower()).select("id")
        found = graph.reach(edges, seeds, depth).filter("depth > 0").join(nodes, "id")
        return found if relation_type == "all" else found.filter(F.col("type") == relation_type)

    @registry.add
    def get_document_details(document_id: int, include_chunks: bool = False) -> DataFrame:
        """A document's fields, and its lines if they are wanted."""
        own = docs.filter(F.col("doc_id") == document_id)
        return own.withColumn("chunks", F.split("text", "\n")) if include_chunks else own

    @registry.add
    def analyze_data_structure(dataset: str = "documents") -> DataFrame:
        """Type, filled share and uniqueness of each field of a dataset."""
        rows = named(dataset)
        kinds = dict(rows.dtypes)
        plain = [c for c, k in kinds.items() if not k.startswith(("array", "map", "struct"))]
        measured = [
            F.struct(
                F.lit(c).alias("field"), F.lit(kinds[c]).alias("type"), F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)).alias("filled"),
                (F.count_distinct(c) / F.greatest(F.count("*"), F.lit(1))).alias("uniqueness")
            ) for c in plain
        ]
        return rows.agg(F.array(*measured).alias("m")).select(F.explode("m").alias("m")).select("m.*")

    @registry.add
    def diagnose_data_quality(category: str = "all") -> DataFrame:
        """Completeness, consistency, structure and linkability of the documents, and their mean."""
        return metadata.quality_report(within(category), "source", ["text", "lang", "source"], ["doc_id", "lang"], "lang", F.contains("text", F.lit("\n")), F.lit(False))

    @registry.add
    def analyze_data_linkage() -> DataFrame:
        """Keys of the datasets and the columns that refer to them."""
        return linkage.references(tables)

    @registry.add
    def calculate_statistics(category: str = "all") -> DataFrame:
        """Documents, share and lengths by category."""
        return metadata.dataset_statistics(within(category), "lang", "n_chars")

    @registry.add
    def aggregate_by_field(field: str, operation: str = "count", limit: int = 10) -> DataFrame:
        """Rows, or characters, by the values of a field, the largest first."""
        measures = {"count": F.count("*"), "sum": F.sum("n_chars"), "avg": F.avg("n_chars")}
        if operation not in measures or field not in docs.columns:
            raise ValueError(f"no {operation!r} by {field!r}")
        return docs.groupBy(field).agg(measures[operation].alias("value")).orderBy(F.desc("value"), field).limit(limit)

    @registry.add
    def compare_datasets(first: str, second: str) -> DataFrame:
        """Documents, characters and mean length of two sources."""
        measures = {"documents": F.count("*"), "characters": F.sum("n_chars"), "mean_length": F.avg("n_chars")}
        return metadata.compare(docs.filter(F.col("source") == first), docs.filter(F.col("source") == second), measures)

    return registry
