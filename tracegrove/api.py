"""A project as one object: its tables, the named tools over them, and the intents composed of tools.

Every tool gives a lazy DataFrame. Requests are held against the bounds of ``schema.BOUNDS``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .functions import text as T
from .operators import graph
from .plans import base
from .plans import doc_queries, graph_queries, score_queries
from .schema import CALLABLE, EDGE_WEIGHTS, bounded
from .sources import scan


def edge_types(names: list[str] | None) -> list[str]:
    """Known edge types among ``names``, whatever their case; none known means no filter."""
    return [n.lower() for n in names or [] if n.lower() in EDGE_WEIGHTS]


class Project:
    """``folder`` holds the Parquet tables (see ``sources.tables``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # -- tables
    def nodes(self, *columns: str) -> DataFrame:
        return base.nodes(self.spark, self.folder, *columns)

    def edges(self, types: list[str] | None = None) -> DataFrame:
        return base.edges(self.spark, self.folder, *edge_types(types))

    def files(self, *columns: str) -> DataFrame:
        return base.files(self.spark, self.folder, *columns)

    def status(self) -> DataFrame:
        return graph_queries.nodes_by_type_counts(self.spark, self.folder)

    # -- graph
    def _ids(self, ids: list[str]) -> DataFrame:
        """The given ids that are nodes."""
        return self.nodes("node_type").where(F.col("id").isin(*ids)).select("id")

    def subgraph(self, roots: list[str], depth: int = 1, direction: str = "both", types: list[str] | None = None, max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
        """Nodes nearest to the roots (at most ``max_nodes``) and the edges between them; calls only unless types are given."""
        bounded("subgraph_depth", depth)
        bounded("subgraph_nodes", max_nodes)
        e = self.edges(types or ["calls"])
        found = graph.reachable(e, self._ids(roots), depth, direction).orderBy("depth", "id").limit(max_nodes)
        return found, graph.induced(e, found).select("src", "dst", "edge_type").distinct()

    def callers_of(self, node_id: str, depth: int = 1) -> DataFrame:
        return graph.reachable(self.edges(["calls"]), self._ids([node_id]), depth, "in").where("depth > 0")

    def callees_of(self, node_id: str, depth: int = 1) -> DataFrame:
        return graph.reachable(self.edges(["calls"]), self._ids([node_id]), depth).where("depth > 0")

    def reachable(self, roots: list[str], depth: int = 10, types: list[str] | None = None, max_nodes: int = 1000) -> DataFrame:
        """The nearest ``max_nodes``; nothing that is computed from the set is cut."""
        bounded("reach_depth", depth)
        bounded("reach_nodes", max_nodes)
        return graph.reachable(self.edges(types), self._ids(roots), depth).orderBy("depth", "id").limit(max_nodes)

    def find_path(self, source: str, target: str, types: list[str] | None = None, max_hops: int = 50) -> DataFrame:
        """The smallest shortest path (one row), or no row."""
        bounded("max_hops", max_hops)
        return graph.shortest_paths(self.edges(types), self._ids([source]), max_hops, stop_at=target).where(F.col("id") == target)

    def entrypoint_paths(self, target: str, entrypoints: list[str], max_hops: int = 10) -> DataFrame:
        """One search backwards from the target."""
        bounded("max_hops", max_hops)
        back = graph.reachable(self.edges(["calls"]), self._ids([target]), max_hops, "in")
        return back.where(F.col("id").isin(*entrypoints)).select("id", F.col("depth").alias("hops")).orderBy("hops", "id")

    def dependency_tree(self, root: str, depth: int = 2, direction: str = "out", types: list[str] | None = None) -> DataFrame:
        bounded("tree_depth", depth)
        return graph.dependency_tree(self.edges(types), self._ids([root]), depth, direction)

    def dead_code(self, roots: list[str]) -> DataFrame:
        return self.dead_code_from(self._ids(roots))

    def dead_code_from(self, roots: DataFrame) -> DataFrame:
        """Functions that none of the roots (id) reaches; neither roots nor what they reach is cut."""
        found = graph.reachable(self.edges(["calls", "imports", "contains"]), roots)
        dead = self.nodes("node_type", "name", "file_path").where(F.col("node_type").isin(*CALLABLE)).join(found.select("id"), "id", "left_anti")
        return dead.where(~F.col("name").rlike("^__.*__$") & ~F.lower("file_path").contains("test"))

    def module_graph(self) -> tuple[DataFrame, DataFrame]:
        return graph_queries.module_graph_nodes(self.spark, self.folder), graph_queries.module_graph_edges(self.spark, self.folder)

    def cycles(self) -> DataFrame:
        return graph.components(graph_queries.module_graph_edges(self.spark, self.folder))

    def layering(self, lower: str = "core", upper: str = "web") -> DataFrame:
        return graph_queries.module_graph_edges(self.spark, self.folder).where(F.contains("src", F.lit(lower)) & F.contains("dst", F.lit(upper)))

    def repo_map(self, budget: int = 1600) -> DataFrame:
        """Per repository its files, classes and functions by PageRank until the token budget overflows."""
        bounded("repo_map_budget", budget)
        return graph_queries.repo_map(self.spark, self.folder, budget)

    def repo_map_report(self, budget: int = 1600) -> dict[str, DataFrame]:
        """The map with the best ten entrypoints, five hotspots and the ten largest modules."""
        modules = self.module_graph()[0].orderBy(F.desc("files"), "module").limit(10)
        return {"map": self.repo_map(budget), "entrypoints": self.entrypoints(10), "hotspots": self.hotspots(5), "modules": modules}

    def cycle_paths(self) -> DataFrame:
        """A shortest cycle of every group of modules that import each other in a circle."""
        return graph.cycles(graph_queries.module_graph_edges(self.spark, self.folder))

    def rank_nodes(self, edges: DataFrame, top: int = 10) -> DataFrame:
        """Nodes of a subgraph by degree."""
        return graph.degrees(edges).orderBy(F.desc("degree"), "id").limit(top)

    def rank_impact(self, found: DataFrame, top: int = 15) -> DataFrame:
        """The nodes of an impact nearest to its roots (id, depth)."""
        return found.orderBy("depth", "id").limit(top)

    # -- search
    def search(self, query: str, limit: int = 10, types: list[str] | None = None, path_prefix: str | None = None) -> DataFrame:
        """Exact names first, then parts of names; the empty query matches all."""
        bounded("search_limit", limit)
        found = self.nodes("name", "node_type", "file_path", "node_seq").where(F.lower("name").contains(query.lower()))
        if types:
            found = found.where(F.col("node_type").isin(*types))
        if path_prefix:
            found = found.where(F.col("file_path").startswith(path_prefix))
        return found.orderBy(F.desc(F.lower("name") == query.lower()), "node_seq").limit(limit)

    def resolve_symbol(self, query: str, prefer: list[str] | None = None, limit: int = 5) -> DataFrame:
        if not query.strip():
            raise ValueError("query is blank")
        bounded("resolve_limit", limit)
        score = F.when(F.col("name") == query, 1.0).otherwise(0.8) + F.when(F.col("node_type").isin(*(prefer or [""])), 0.2).otherwise(0.0)
        return self.search(query, min(500, limit * 2)).withColumn("score", score).orderBy(F.desc("score"), "node_seq").limit(limit)

    def grep(self, query: str, limit: int = 50) -> DataFrame:
        rows = self.files("content").where(F.lower("content").contains(query.lower())).select("relative_path", F.posexplode(T.lines(F.col("content"))).alias("pos", "line"))
        return rows.where(F.lower("line").contains(query.lower())).select("relative_path", (F.col("pos") + 1).alias("line_no"), F.trim("line").alias("line")).orderBy("relative_path", "line_no").limit(limit)

    def semantic_search(self, query: str, limit: int = 5, index: str | None = None, types: list[str] | None = None) -> DataFrame:
        """Nearest symbols by hashed words (in the place of a model's vectors): those of ``index``, if it is built, else of name and docstring."""
        bounded("semantic_limit", limit)
        if index:
            vectors = self.spark.read.parquet(index).where(F.col("node_type").isin(*(types or SEARCHED))).select("id", "name", F.col("vector").alias("v"))
        else:
            shown = self.nodes("node_type", "name", "docstring").where(F.col("node_type").isin(*(types or SEARCHED)))
            vectors = shown.select("id", "name", hashed_vector(F.concat_ws(" ", "name", "docstring")).alias("v"))
        q = self.spark.range(1).select(hashed_vector(F.lit(query)).alias("v")).first()["v"]
        d = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in q]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return vectors.select("id", "name", d.alias("d")).orderBy("d", "id").limit(limit).withColumn("score", 1 / (1 + F.col("d")))

    def symbol_info(self, name_or_id: str, depth: int = 1) -> DataFrame:
        """The node of that id, else the best match of the name, with how many call it and are called within ``depth``."""
        own = self.nodes("node_type", "name", "file_path", "line_start", "line_end", "signature", "docstring")
        found = graph.cut(own.where(F.col("id") == name_or_id))
        if not found.take(1):
            found = graph.cut(own.join(self.resolve_symbol(name_or_id, limit=1).select("id"), "id", "left_semi"))
        ids, calls = found.select("id"), self.edges(["calls"])
        callers = graph.reachable(calls, ids, depth, "in").where("depth > 0").agg(F.count("*").alias("callers"))
        callees = graph.reachable(calls, ids, depth).where("depth > 0").agg(F.count("*").alias("callees"))
        return found.join(callers, F.lit(True)).join(callees, F.lit(True))

    def function_info(self, name: str) -> DataFrame:
        """The named functions with their callers and callees: counts, and the first ten of each."""
        own = self.nodes("node_type", "name", "file_path", "signature", "docstring").where(F.col("node_type").isin(*CALLABLE) & ((F.col("name") == name) | (F.col("id") == name)))
        calls = self.edges(["calls"]).select("src", "dst").distinct()

        def side(near: str, far: str, n: str, names: str) -> DataFrame:
            near_calls = calls.join(own.select(F.col("id").alias(near)), near, "left_semi").withColumnRenamed(near, "id")
            place = F.row_number().over(Window.partitionBy("id").orderBy(far))  # ten rows of a key reach the window
            first = near_calls.withColumn("_n", place).where("_n <= 10").groupBy("id").agg(F.array_sort(F.collect_list(far)).alias(names))
            return near_calls.groupBy("id").agg(F.count("*").alias(n)).join(first, "id")

        out = own.join(side("dst", "src", "n_callers", "callers"), "id", "left").join(side("src", "dst", "n_callees", "callees"), "id", "left")
        return out.fillna(0, ["n_callers", "n_callees"])

    def build_index(self, path: str, force: bool = False) -> DataFrame:
        """Vectors of symbols with their code, of sections and of file overviews, written once to ``path`` and again only if forced."""
        if force or not self._exists(path):
            doc_queries.chunks(self.spark, self.folder).withColumn("vector", hashed_vector(F.col("content"))).write.mode("overwrite").parquet(path)
            meta = self.spark.read.parquet(path).agg(F.count("*").alias("chunks")).select(F.lit(VECTOR).alias("width"), "chunks", F.lit("hashed words").alias("model"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("written_at"))
            meta.write.mode("overwrite").parquet(f"{path}-meta")
        return self.spark.read.parquet(path)

    def index_meta(self, path: str) -> DataFrame | None:
        """width, chunks, model and written_at of the index, or None if there is none."""
        return self.spark.read.parquet(f"{path}-meta") if self._exists(f"{path}-meta") else None

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    # -- scores, docs, files
    def hotspots(self, top: int = 20) -> DataFrame:
        bounded("top_n", top)
        return score_queries.axes(self.spark, self.folder).orderBy(F.desc("total"), "path").limit(top)

    def entrypoints(self, limit: int = 100, kind: str | None = None, contains: str | None = None) -> DataFrame:
        """Candidates by score; of one kind of node or with ``contains`` in name or path, if given."""
        bounded("entrypoint_limit", limit)
        found = self.all_entrypoints()
        if kind:
            found = found.where(F.col("node_type") == kind)
        if contains:
            found = found.where(F.lower("name").contains(contains.lower()) | F.lower("file_path").contains(contains.lower()))
        return found.orderBy(F.desc("score"), "id").limit(limit)

    def all_entrypoints(self) -> DataFrame:
        shown = self.nodes("node_type", "name", "file_path")
        return score_queries.entrypoint_scores(self.spark, self.folder).join(shown, "id")

    def pick_best_entrypoint(self, query: str) -> DataFrame:
        """The best entrypoint whose name holds the query, else the best of all; one row at most."""
        hit = F.lower("name").contains(query.lower())
        return self.all_entrypoints().orderBy(F.desc(hit), F.desc("score"), "id").limit(1)

    def security_summary(self, words: list[str], top: int = 10) -> DataFrame:
        """Per word the names that hold it: how many, and the first ``top``."""
        shown = self.nodes("name", "node_seq").where("name is not null")
        hits = shown.withColumn("word", F.explode(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("name"), F.lower(w)))))
        place = F.row_number().over(Window.partitionBy("word").orderBy("node_seq"))
        first = hits.withColumn("_n", place).where(F.col("_n") <= top).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]).alias("names"))
        return hits.groupBy("word").agg(F.count("*").alias("n")).join(first, "word")

    def doc_coverage(self) -> DataFrame:
        return doc_queries.doc_coverage(self.spark, self.folder)

    def _text(self, path: str, **facts) -> DataFrame:
        """Facts of one file; a path that leads out of the root, or that the ignore rules hide, is refused."""
        plain = scan.inside(path)
        hidden = self.spark.range(1).select(scan.ignored(F.lit(plain), scan.IGNORED)).first()[0]
        if hidden:
            raise PermissionError(f"{path!r} is ignored")
        return base.file_facts(self.spark, self.folder, **facts).where(F.col("relative_path") == plain)  # the filter reaches the scan

    def read_span(self, path: str, start: int, end: int) -> DataFrame:
        return self._text(path, span=scan.span(F.col("content"), start, end))

    def read_file_span(self, path: str, start: int, end: int, context: int = 20, max_bytes: int = 200_000) -> DataFrame:
        return self._text(path, s=scan.span_bytes(F.col("content"), start, end, context, max_bytes)).select("relative_path", "s.*")

    def read_file(self, path: str) -> DataFrame:
        """The file with its lines numbered."""
        return self._text(path, content=scan.numbered_file(F.col("content")))

    def read_file_raw(self, path: str, max_bytes: int = 200_000) -> DataFrame:
        return self._text(path, s=scan.raw_file(F.col("content"), max_bytes)).select("relative_path", "s.*")

    def list_directory(self, folder: str) -> DataFrame:
        return scan.list_directory(self.files("mtime")).where(F.col("folder") == folder).orderBy("is_file", F.lower("name"))

    # -- intents
    def intent(self, name: str, **args) -> dict[str, DataFrame | tuple[DataFrame, DataFrame]]:
        """The named intent's results, by tool."""
        if name not in INTENTS:
            raise ValueError(f"unknown intent {name!r}")
        return INTENTS[name](self, **args)


def render_mermaid(nodes: DataFrame, edges: DataFrame, max_nodes: int = 200) -> str:
    """A flow chart of a subgraph of at most ``max_nodes`` nodes with all edges between them, as text."""
    bounded("subgraph_nodes", max_nodes)
    safe = lambda c: T.mermaid_id(F.col(c))
    held = nodes.select("id").orderBy("id").limit(max_nodes)
    lines = [f'    {r.k}["{r.id}"]' for r in held.select("id", safe("id").alias("k")).orderBy("id").collect()]
    # pairs of at most ``max_nodes`` nodes, each once
    lines += [f"    {r.a} --> {r.b}" for r in graph.induced(edges, held).select(safe("src").alias("a"), safe("dst").alias("b")).distinct().orderBy("a", "b").collect()]
    return "\n".join(["graph TD", *lines])


def summarize_hotspots(report: DataFrame, top: int = 10) -> str:
    """The report's best lines as a list."""
    bounded("top_n", top)
    rows = report.orderBy(F.desc("total"), "path").limit(top).collect()
    return "\n".join(f"- {r.path}: {r.total:.2f}" for r in rows) or "No hotspots."


def search_tools(query: str) -> list[str]:
    """Names of the project's tools whose name or description holds the query."""
    found = [n for n in dir(Project) if not n.startswith("_") and query.lower() in f"{n} {getattr(Project, n).__doc__ or ''}".lower()]
    return sorted(found)


VECTOR = 64
SEARCHED = ("class", "function", "method", "doc_section", "file")


@F.pandas_udf(ArrayType(DoubleType()))
def _vectors(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        words = re.findall("[a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", text or "").lower())
        places = np.fromiter((zlib.crc32(w.encode()) % (2 * VECTOR) for w in words), np.int64, len(words))
        counts = np.bincount(places, minlength=2 * VECTOR).astype(float)
        v = counts[:VECTOR] - counts[VECTOR:]
        out.append(v / (np.linalg.norm(v) or 1.0))
    return pd.Series(out)


def hashed_vector(text) -> F.Column:
    """Unit vector of hashed words: each word adds or takes one at its place; no words give zeros."""
    return _vectors(text)


def _seeds(p: Project, query: str, most: int = 10) -> list[str]:
    """Ids found by meaning and by name: semantic score, 0.5 more for both, 0.5 for the name alone."""
    a = p.semantic_search(query, 12).select("id", "score")
    b = p.search(query, 20).select("id", F.lit(True).alias("lex"))
    fused = a.join(b, "id", "full_outer").select("id", (F.coalesce("score", F.lit(0.0)) + F.when(F.col("lex"), 0.5).otherwise(0.0)).alias("score"))
    return [r.id for r in fused.orderBy(F.desc("score"), "id").limit(most).collect()]


def _first(p: Project, query: str) -> list[str]:
    return [r.id for r in p.resolve_symbol(query, limit=1).collect()]


def _entries(p: Project, n: int) -> list[str]:
    return [r.id for r in p.entrypoints(n).collect()]


def _one(found: list[str], run, empty):
    """What ``run`` gives for the symbol that was found, or the empty result."""
    return run(*found) if found else empty()


def _path(p: Project, source: str, target: str) -> DataFrame:
    a, b = _first(p, source), _first(p, target)
    return p.find_path(a[0], b[0]) if a and b else p.spark.createDataFrame([], "id string, hops int, path array<string>")


INTENTS = {
    "architecture_consistency": lambda p: {"map": p.repo_map(), "modules": p.module_graph(), "cycles": p.cycles(), "layering": p.layering()},
    "change_impact": lambda p, query: {"impact": p.subgraph(_first(p, query), 2, "in"), "entrypoints": p.entrypoints()},
    "change_plan": lambda p: {"map": p.repo_map(), "hotspots": p.hotspots()},
    "codebase_overview": lambda p: {"map": p.repo_map(), "entrypoints": p.entrypoints(10), "hotspots": p.hotspots(5), "modules": p.module_graph()},
    "dead_code": lambda p: {"dead": p.dead_code_from(p.all_entrypoints())},
    "debug_troubleshoot": lambda p, query: {"around": p.subgraph(_seeds(p, query), 2, "both")},
    "entrypoints_callgraph": lambda p: {"calls": p.subgraph(_entries(p, 100), 3, "out")},
    "execution_graph_static": lambda p, query: {"calls": p.subgraph(_first(p, query), 3, "out")},
    "execution_graph_dynamic": lambda p: {"flow": graph_queries.trace_flow_edges(p.spark, p.folder)},
    "feature_slice": lambda p, query: {"slice": p.subgraph(_seeds(p, query), 1, "both", ["calls", "imports", "contains"])},
    "graph_dependency_tree": lambda p, query: {"tree": _one(_first(p, query), p.dependency_tree, lambda: p.spark.createDataFrame([], "root string, id string, depth int, recursive boolean, path array<string>"))},
    "graph_path": lambda p, source, target: {"path": _path(p, source, target)},
    "hotspots_report": lambda p, top=20: {"hotspots": p.hotspots(top)},
    "mcp_capabilities": lambda p: {"intents": p.spark.createDataFrame([(k,) for k in sorted(INTENTS)], "intent string")},
    "refactor_guidance": lambda p, query: {"in": p.subgraph(_first(p, query), 3, "in"), "out": p.subgraph(_first(p, query), 2, "out"), "hotspots": p.hotspots()},
    "security_review": lambda p, words=("password", "token", "exec", "eval", "secret"): {w: p.search(w, 10) for w in words},
    "symbol_lookup": lambda p, query: {"symbol": p.resolve_symbol(query), "around": p.subgraph(_first(p, query), 1, "both")},
}
