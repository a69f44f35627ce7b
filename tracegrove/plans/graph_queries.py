"""Queries over the property graph: lookups, joins, traversals, ranks, contraction, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.relational import current_rows, first_by, positions
from ..schema import EDGE_WEIGHTS
from ..sources.tables import table
from .base import all_edges, edges, functions, nodes, sql

WALK = ("imports", "contains", "calls")
DEPTH, HOPS, ENTRY_HOPS = 10, 50, 10  # default bounds of walks
BUDGET = 1600


def path_of() -> F.Column:
    return F.coalesce("relative_path", "file_path")


def module_of(path) -> F.Column:
    name = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(name == "", "root").otherwise(name)


def weight() -> F.Column:
    default = F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv])
    return F.coalesce("weight", default[F.col("edge_type")], F.lit(1.0))


def roots(spark: SparkSession, d: str) -> DataFrame:
    """Per repository the file that imports most others (ties: smallest id)."""
    counts = edges(spark, d, "imports").groupBy("src").agg(F.countDistinct("dst").alias("n")).withColumn("repository", F.split("src", "/")[0])
    return first_by(counts, ["repository"], [F.desc("n"), F.col("src")]).select(F.col("src").alias("id"))


def nodes_by_type_counts(spark, d):
    return nodes(spark, d, "node_type").groupBy("node_type").agg(F.count("*").alias("n"))


def edges_by_type_weight(spark, d):
    return edges(spark, d).withColumn("w", weight()).groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("total_weight"))


def upsert_latest_node(spark, d):
    rows = table(spark, d, "nodes").where("id is not null")
    return current_rows(rows, "id", [F.col("node_seq")], ["node_seq", "name", "node_type", "file_path"]).select("id", "node_seq", "name", "node_type", "file_path")


def drop_dangling_edges(spark, d):
    return edges(spark, d).select("edge_seq", "src", "dst", "edge_type")


def _calls(spark, d, near, far):
    ids = functions(spark, d).select(F.col("id").alias(far))
    return edges(spark, d, "calls").join(ids, far, "left_semi").select(F.col(near).alias("id"), F.col(far).alias("other")).distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("first"))


def callers_one_hop(spark, d):
    return _calls(spark, d, "dst", "src")


def callees_one_hop(spark, d):
    return _calls(spark, d, "src", "dst")


def callers_depth_k(spark, d):
    """Everything that reaches a function of a root file over calls, within three steps."""
    start = edges(spark, d, "contains").join(roots(spark, d).withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    found = graph.reachable(edges(spark, d, "calls"), start, 3, "in")
    return found.where("depth > 0").select("id", "depth")


def file_contents(spark, d):
    held = edges(spark, d, "contains").join(nodes(spark, d, "node_type").select(F.col("id").alias("dst"), "node_type"), "dst")
    return held.groupBy("src").agg(F.countDistinct("dst").alias("n"), F.countDistinct(F.when(F.col("node_type") == "class", F.col("dst"))).alias("classes")).withColumnRenamed("src", "id")


def khop_subgraph_nodes(spark, d):
    return graph.reachable(edges(spark, d, *WALK), roots(spark, d), 2)


def khop_induced_edges(spark, d):
    e = edges(spark, d, *WALK)
    return graph.induced(e, graph.reachable(e, roots(spark, d), 2)).select("edge_seq", "src", "dst", "edge_type")


def multi_root_subgraph(spark, d):
    """Both directions, edges once per pair."""
    e = edges(spark, d, "imports")
    return graph.induced(e, graph.reachable(e, roots(spark, d), 1, "both")).select("src", "dst").distinct()


def reachable_set(spark, d):
    return graph.reachable(edges(spark, d), roots(spark, d), DEPTH)


def reachable_typed(spark, d):
    found = graph.reachable(edges(spark, d, "imports", "calls"), roots(spark, d), DEPTH)
    return found.join(nodes(spark, d, "node_type"), "id").groupBy("node_type", "depth").agg(F.count("*").alias("n"))


def shortest_path_length(spark, d):
    return graph.shortest_paths(edges(spark, d, *WALK), roots(spark, d), HOPS).select("id", "hops", F.size("path").alias("length"))


def path_to_subgraph(spark, d):
    """The adjacent pairs of the shortest import paths from the roots, as edges."""
    return graph.path_edges(graph.shortest_paths(edges(spark, d, "imports"), roots(spark, d), HOPS)).select("src", "dst", "edge_type").distinct()


def entrypoint_paths_len(spark, d):
    """Hops from each function without callers to the most called function, by one search backwards."""
    return _entrypoint_paths(spark, d, ENTRY_HOPS)


def _entrypoint_paths(spark, d, depth):
    calls = edges(spark, d, "calls")
    target = calls.groupBy("dst").agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("id"))
    back = graph.reachable(calls, target, depth, "in")
    return back.join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.col("depth").alias("hops"))


# The four queries above keep to default bounds; the same without a bound, until the frontier is empty.


def reachable_set_whole(spark, d):
    return graph.reachable(edges(spark, d), roots(spark, d))


def reachable_typed_whole(spark, d):
    found = graph.reachable(edges(spark, d, "imports", "calls"), roots(spark, d))
    return found.join(nodes(spark, d, "node_type"), "id").groupBy("node_type", "depth").agg(F.count("*").alias("n"))


def shortest_path_length_whole(spark, d):
    return graph.shortest_paths(edges(spark, d, *WALK), roots(spark, d), None).select("id", "hops", F.size("path").alias("length"))


def entrypoint_paths_len_whole(spark, d):
    return _entrypoint_paths(spark, d, None)


def dependency_tree_paths(spark, d):
    tree = graph.dependency_tree(edges(spark, d, "imports"), roots(spark, d), 2)
    return tree.select("root", "id", "depth", "recursive", F.array_join("path", " > ").alias("path"))


def dead_code_antijoin(spark, d):
    found = graph.reachable(edges(spark, d, *WALK), roots(spark, d))
    dead = functions(spark, d, "name", "file_path").join(found.select("id"), "id", "left_anti")
    return dead.where(~F.col("name").rlike("^__.*__$") & ~F.lower("file_path").contains("test")).select("id", "name", "file_path")


def file_coupling_degrees(spark, d):
    """Distinct files in and out over imports and calls; files without edges have zeros."""
    files = nodes(spark, d, "node_type", "file_path", "relative_path").withColumn("file", path_of())
    at = files.where("file is not null").select("id", "file")
    pairs = edges(spark, d, "imports", "calls").join(at.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").where("a <> b").select("a", "b").distinct()
    ins, outs = pairs.groupBy(F.col("b").alias("file")).agg(F.count("*").alias("n_in")), pairs.groupBy(F.col("a").alias("file")).agg(F.count("*").alias("n_out"))
    every = files.where("node_type = 'file' and file is not null").select("file").distinct()
    n_in, n_out = F.coalesce("n_in", F.lit(0)), F.coalesce("n_out", F.lit(0))
    return every.join(ins, "file", "left").join(outs, "file", "left").select("file", n_in.alias("n_in"), n_out.alias("n_out"), F.round(n_in * 0.3 + n_out * 0.2, 6).alias("coupling"))


def _modules(spark, d):
    files = nodes(spark, d, "node_type", "file_path", "relative_path").where("node_type = 'file'").withColumn("path", path_of())
    return files.where("path is not null").select("id", module_of(F.col("path")).alias("group"))


def module_graph_nodes(spark, d):
    return _modules(spark, d).groupBy(F.col("group").alias("module")).agg(F.count("*").alias("files"))


def module_graph_edges(spark, d):
    return graph.contract(edges(spark, d, "imports"), _modules(spark, d))


def pagerank_module(spark, d):
    links = graph.cut(module_graph_edges(spark, d).select("src", "dst"))
    ids = links.select(F.col("src").alias("id")).union(links.select("dst"))
    return graph.pagerank(links, ids).select("id", F.round("rank", 8).alias("rank"))


def pagerank_nodes(spark, d):
    """Ranks of all nodes of the whole graph."""
    return graph.pagerank(edges(spark, d), nodes(spark, d, "node_type")).select("id", F.round("rank", 8).alias("rank"))


def cycle_nodes_module(spark, d):
    return graph.components(module_graph_edges(spark, d)).select("id")


def cycle_paths_module(spark, d):
    """A shortest cycle of every group of modules that import each other in a circle."""
    return graph.cycles(module_graph_edges(spark, d)).select("component", "hops", F.array_join("path", " > ").alias("path"))


def cycle_components_calls(spark, d):
    """Groups of functions that call each other in a circle."""
    return graph.components(edges(spark, d, "calls")).groupBy("component").agg(F.count("*").alias("size"))


def cycle_components_references(spark, d):
    """Groups of nodes that edges of calls, imports, inheritance and documentation tie into circles."""
    found = graph.components(edges(spark, d, "calls", "imports", "inherits", "documents", "documented_by"))
    return found.groupBy("component").agg(F.count("*").alias("size"))


def degree_rank_topk(spark, d):
    return graph.degrees(edges(spark, d)).orderBy(F.desc("degree"), "id").limit(20)


def layering_violations(spark, d):
    return module_graph_edges(spark, d).where("contains(src, 'core') and contains(dst, 'view')")


def inherits_cross_file(spark, d):
    """Classes per base, with the share of subclasses in other files."""
    at = nodes(spark, d, "file_path", "name")
    pairs = edges(spark, d, "inherits").join(at.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("file_path").alias("b"), F.col("name").alias("base")), "dst")
    return pairs.groupBy("base").agg(F.countDistinct("src").alias("subclasses"), F.countDistinct(F.when(F.col("a") != F.col("b"), F.col("src"))).alias("cross_file"))


def table_lineage(spark, d):
    """Tables with the queries that read and write them; a written table is also read."""
    e = edges(spark, d, "reads", "writes")
    return e.groupBy(F.col("dst").alias("id")).agg(F.countDistinct(F.when(F.col("edge_type") == "reads", F.col("src"))).alias("readers"), F.countDistinct(F.when(F.col("edge_type") == "writes", F.col("src"))).alias("writers"))


def map_entries(known):
    """How nodes stand in a map: ``entry``, what it costs in tokens (``test``), and what it adds (``cost``: files and others nothing)."""
    bases = F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))).otherwise("")
    owned = F.when((F.col("node_type") == "method") & F.col("class_name").isNotNull(), F.concat_ws(".", "class_name", "name")).otherwise(F.col("name"))
    sign = F.when(F.col("node_type") == "method", "\U0001f539 ").otherwise("\u26a1 ")
    entry = (
        F.when(F.col("node_type") == "file", F.concat(F.lit("\U0001f4c4 "), path_of())).when(F.col("node_type") == "class", F.concat(F.lit("\U0001f537 class "), "name", bases))
        .when(F.col("node_type").isin("function", "method"), F.concat(sign, F.coalesce(F.when(F.col("signature") != "", F.col("signature")), F.concat(owned, F.lit("()"))))).otherwise(F.concat(F.lit("\u2022 "), "name"))
    )
    rows = known.withColumn("entry", F.coalesce(entry, F.lit("")))
    test = F.floor(F.length("entry") * 0.25).cast("long")
    return rows.withColumn("test", test).withColumn("cost", F.when(F.col("node_type").isin("class", "function", "method"), test).otherwise(0))


def repo_map(spark, d, budget):
    """Per repository its nodes by rank, until an entry overflows the token budget."""
    known = nodes(spark, d, "node_type", "name", "file_path", "relative_path", "class_name", "signature", "bases", "node_seq").where(path_of().isNotNull())
    ranked = known.join(graph.pagerank(edges(spark, d), nodes(spark, d, "node_type")), "id")
    rows = map_entries(ranked).withColumn("repository", F.split(path_of(), "/")[0]).withColumn("down", -F.round("rank", 8))
    kept = graph.budget_cut(rows.select("repository", "id", "node_type", path_of().alias("path"), "entry", "test", "cost", "down", "node_seq"), ["down", "node_seq"], "cost", budget, "repository", "test")
    return kept.where("node_type in ('file', 'class', 'function', 'method')")


def repo_map_budget_cut(spark, d):
    return repo_map(spark, d, BUDGET).select("repository", "id", "entry", "cost", "running")


def trace_flow_edges(spark, d):
    """Adjacent events of each user as a trace, counted per pair of types."""
    placed = graph.cut(positions(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "pos", "event_type"))
    after = placed.select("user_id", (F.col("pos") - 1).alias("pos"), F.col("event_type").alias("dst"))
    return placed.join(after, ["user_id", "pos"]).groupBy(F.col("event_type").alias("src"), "dst").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        nodes_by_type_counts, edges_by_type_weight, upsert_latest_node, drop_dangling_edges, callers_one_hop, callees_one_hop, callers_depth_k, file_contents, khop_subgraph_nodes, khop_induced_edges, multi_root_subgraph,
        reachable_set, reachable_typed, shortest_path_length, path_to_subgraph, entrypoint_paths_len, dependency_tree_paths,
        reachable_set_whole, reachable_typed_whole, shortest_path_length_whole, entrypoint_paths_len_whole, dead_code_antijoin, file_coupling_degrees, module_graph_nodes, module_graph_edges, pagerank_module,
        pagerank_nodes, cycle_nodes_module, cycle_paths_module, cycle_components_calls, cycle_components_references, degree_rank_topk, layering_violations, inherits_cross_file, table_lineage, repo_map_budget_cut, trace_flow_edges,
    )
}

_WEIGHT = "coalesce(weight, case edge_type " + " ".join(f"when '{k}' then {v}" for k, v in EDGE_WEIGHTS.items()) + " else 1.0 end)"
_ROOTS = "roots as (select src as id from (select src, row_number() over (partition by split_part(src, '/', 1) order by count(distinct dst) desc, src) rn from le where edge_type = 'imports' group by src) where rn = 1)"
_MOD = """fm as (select id, case when regexp_extract(p, '^(.*)/[^/]*$', 1) = '' then 'root' else regexp_extract(p, '^(.*)/[^/]*$', 1) end as grp
  from (select id, coalesce(relative_path, file_path) p from cn where node_type = 'file') where p is not null),
me as (select a.grp as src, b.grp as dst, count(*) weight from le join fm a on a.id = le.src join fm b on b.id = le.dst where edge_type = 'imports' and a.grp <> b.grp group by 1, 2)"""


def _bfs(name: str, start: str, where: str, depth: int | None, near: str = "src", far: str = "dst") -> str:
    """Breadth-first search; each round adds the nodes that no round before it has reached."""
    bound = f" and depth < {depth}" if depth is not None else ""
    return f"{name}(id, depth) using key (id) as (select distinct id, 0 from {start} union select e.{far}, min(depth) + 1 from {name} b join (select distinct src, dst from le where {where}) e on e.{near} = b.id where e.{far} not in (select id from recurring.{name}){bound} group by e.{far})"


def _paths(name: str, start: str, links: str, hops: int | None) -> str:
    """As ``_bfs`` with the smallest of the shortest paths."""
    bound = f" and hops < {hops}" if hops is not None else ""
    return f"{name}(id, hops, path) using key (id) as (select distinct id, 0, [id] from {start} union select e.dst, min(hops) + 1, list_append(min(path), e.dst) from {name} b join {links} e on e.src = b.id where e.dst not in (select id from recurring.{name}){bound} group by e.dst)"


_W = "edge_type in ('imports', 'contains', 'calls')"
_CALLS, _IMPORTS_CALLS = "edge_type = 'calls'", "edge_type in ('imports', 'calls')"
_TARGET = "tg as (select dst as id from le where edge_type = 'calls' group by dst order by count(distinct src) desc, dst limit 1)"
_CALLABLE = "(select id from cn where node_type in ('function', 'method'))"


def _rank(links: str, ids: str) -> str:
    """PageRank as in ``graph.pagerank``: links(src, dst) with repetitions, ids(id); the result is pr(id, rank)."""
    return f"""pl as materialized (select src, dst, count(*) * 1.0::double / sum(count(*)) over (partition by src) share from {links} group by src, dst), pi as materialized (select distinct id from {ids} where id is not null),
pk(k, id, y) as (select 0, id, 1.0::double from pi union all select g.k + 1, pi.id, 1 + 0.85::double * coalesce(c.came, 0) from pi cross join (select max(k) k from pk) g left join (select dst, sum(share * y) came from pl join pk on pk.id = pl.src group by dst) c on c.dst = pi.id where g.k < {graph.ROUNDS}),
pe as (select a.k, sum(abs(a.y - b.y)) / sum(a.y) as change from pk a join pk b on b.id = a.id and b.k = a.k - {graph.STEP} where a.k % {graph.STEP} = 0 group by a.k),
pr as (select id, y / sum(y) over () as rank from pk where k = (select coalesce(min(case when change < {graph.TOLERANCE} then k end), {graph.ROUNDS}) from pe))"""


_MAP = r"""mp as (select id, split_part(coalesce(relative_path, file_path), '/', 1) as repository, node_type, node_seq, -round(rank, 8) as down,
  coalesce(case when node_type = 'file' then chr(128196) || ' ' || coalesce(relative_path, file_path) when node_type = 'class' then chr(128311) || ' class ' || name || case when len(bases) > 0 then '(' || array_to_string(bases, ', ') || ')' else '' end
    when node_type in ('function', 'method') then case when node_type = 'method' then chr(128313) else chr(9889) end || ' ' || coalesce(nullif(signature, ''), case when node_type = 'method' and class_name is not null then class_name || '.' || name else name end || '()') else chr(8226) || ' ' || name end, '') as entry
  from cn join pr using (id) where coalesce(relative_path, file_path) is not null),
mq as (select *, cast(floor(length(entry) * 0.25) as bigint) as test, case when node_type in ('class', 'function', 'method') then cast(floor(length(entry) * 0.25) as bigint) else 0 end as cost from mp),
ms as (select *, cast(sum(cost) over w as bigint) as running, row_number() over w as rn from mq window w as (partition by repository order by down, node_seq rows between unbounded preceding and current row)),
mo as (select repository, min(rn) as cut from ms where running - cost + test > 1600 group by 1)"""

ORACLES = {
    "nodes_by_type_counts": sql("select node_type, count(*) n from cn group by 1"),
    "edges_by_type_weight": sql(f"select edge_type, count(*) n, round(sum({_WEIGHT}), 6) total_weight from le group by 1"),
    "upsert_latest_node": sql("select id, node_seq, name, node_type, file_path from (select *, row_number() over (partition by id order by node_seq desc) rn from nodes where id is not null) where rn = 1"),
    "drop_dangling_edges": sql("select edge_seq, src, dst, edge_type from le"),
    "callers_one_hop": sql(f"select dst as id, count(distinct src) n, min(src) as first from le where edge_type = 'calls' and src in {_CALLABLE} group by 1"),
    "callees_one_hop": sql(f"select src as id, count(distinct dst) n, min(dst) as first from le where edge_type = 'calls' and dst in {_CALLABLE} group by 1"),
    "callers_depth_k": sql(f", {_ROOTS}, st as (select distinct dst as id from le where edge_type = 'contains' and src in (select id from roots)), {_bfs('b', 'st', _CALLS, 3, 'dst', 'src')} select id, cast(min(depth) as integer) depth from b group by id having min(depth) > 0"),
    "file_contents": sql("select src as id, count(distinct dst) n, count(distinct case when node_type = 'class' then dst end) classes from le join cn on cn.id = le.dst where edge_type = 'contains' group by 1"),
    "khop_subgraph_nodes": sql(f", {_ROOTS}, {_bfs('b', 'roots', _W, 2)} select id, cast(min(depth) as integer) depth from b group by id"),
    "khop_induced_edges": sql(f", {_ROOTS}, {_bfs('b', 'roots', _W, 2)} select edge_seq, src, dst, edge_type from le where {_W} and src in (select id from b) and dst in (select id from b)"),
    "multi_root_subgraph": sql(f", {_ROOTS}, m as (select id from roots union select dst from le where edge_type = 'imports' and src in (select id from roots) union select src from le where edge_type = 'imports' and dst in (select id from roots)) select distinct src, dst from le where edge_type = 'imports' and src in (select id from m) and dst in (select id from m)"),
    "reachable_set": sql(f", {_ROOTS}, {_bfs('b', 'roots', 'true', DEPTH)} select id, cast(min(depth) as integer) depth from b group by id"),
    "reachable_typed": sql(f", {_ROOTS}, {_bfs('b', 'roots', _IMPORTS_CALLS, DEPTH)}, f as (select id, min(depth) depth from b group by id) select node_type, cast(depth as integer) depth, count(*) n from f join cn using (id) group by 1, 2"),
    "shortest_path_length": sql(f", {_ROOTS}, {_bfs('b', 'roots', _W, HOPS)} select id, cast(depth as integer) hops, cast(depth + 1 as integer) as length from b"),
    "entrypoint_paths_len": sql(f", {_TARGET}, {_bfs('b', 'tg', _CALLS, ENTRY_HOPS, 'dst', 'src')} select id, cast(depth as integer) hops from b where id not in (select dst from le where edge_type = 'calls')"),
    "reachable_set_whole": sql(f", {_ROOTS}, {_bfs('b', 'roots', 'true', None)} select id, cast(depth as integer) depth from b"),
    "reachable_typed_whole": sql(f", {_ROOTS}, {_bfs('b', 'roots', _IMPORTS_CALLS, None)} select node_type, cast(depth as integer) depth, count(*) n from b join cn using (id) group by 1, 2"),
    "shortest_path_length_whole": sql(f", {_ROOTS}, {_bfs('b', 'roots', _W, None)} select id, cast(depth as integer) hops, cast(depth + 1 as integer) as length from b"),
    "entrypoint_paths_len_whole": sql(f", {_TARGET}, {_bfs('b', 'tg', _CALLS, None, 'dst', 'src')} select id, cast(depth as integer) hops from b where id not in (select dst from le where edge_type = 'calls')"),
    "path_to_subgraph": sql(f", {_ROOTS}, ie as (select distinct src, dst from le where edge_type = 'imports'), {_paths('b', 'roots', 'ie', HOPS)} select distinct src, dst, 'path' as edge_type from (select unnest(path[:-2]) as src, unnest(path[2:]) as dst from b where len(path) > 1)"),
    "cycle_paths_module": sql(f", {_MOD}, rr(a, b) as (select src, dst from me union select rr.a, me.dst from rr join me on me.src = rr.b), cy as (select distinct x.a as id, max(x.b) as component from rr x join rr y on x.a = y.b and x.b = y.a group by 1), ci as (select distinct me.src, me.dst from me join cy p on p.id = me.src join cy q on q.id = me.dst where p.component = q.component), st as (select distinct component as id from cy), {_paths('b', 'st', 'ci', None)}, k as (select path[1] as component, hops, path, row_number() over (partition by path[1] order by hops, path) rn from b join ci on ci.src = b.id and ci.dst = b.path[1]) select component, cast(hops + 1 as integer) as hops, array_to_string(list_append(path, component), ' > ') as path from k where rn = 1"),
    "cycle_components_references": sql(", ce as (select distinct src, dst from le where edge_type in ('calls', 'imports', 'inherits', 'documents', 'documented_by')), rr(a, b) as (select src, dst from ce union select rr.a, ce.dst from rr join ce on ce.src = rr.b), cy as (select x.a as id, max(x.b) as component from rr x join rr y on x.a = y.b and x.b = y.a group by 1) select component, count(*) size from cy group by 1"),
    "cycle_components_calls": sql(", ce as (select distinct src, dst from le where edge_type = 'calls'), rr(a, b) as (select src, dst from ce union select rr.a, ce.dst from rr join ce on ce.src = rr.b), cy as (select x.a as id, max(x.b) as component from rr x join rr y on x.a = y.b and x.b = y.a group by 1) select component, count(*) size from cy group by 1"),
    "dependency_tree_paths": sql(
        f", {_ROOTS}, ie as (select distinct src, dst from le where edge_type = 'imports'), p1 as (select r.id as root, e.dst as id, e.dst = r.id as rec, r.id || ' > ' || e.dst as path from roots r join ie e on e.src = r.id) "
        "select id as root, id, 0 as depth, false as recursive, id as path from roots union all select root, id, 1, rec, path from p1 union all select p1.root, e.dst, 2, e.dst in (p1.root, p1.id), p1.path || ' > ' || e.dst from p1 join ie e on e.src = p1.id where not rec"
    ),
    "dead_code_antijoin": sql(f", {_ROOTS}, b(id) as (select id from roots union select e.dst from b join (select distinct src, dst from le where {_W}) e on e.src = b.id) select id, name, file_path from cn where node_type in ('function', 'method') and id not in (select id from b) and not regexp_matches(name, '^__.*__$') and not contains(lower(file_path), 'test')"),
    "file_coupling_degrees": sql(
        ", ft as (select id, coalesce(relative_path, file_path) as file, node_type from cn), pr as (select distinct a.file as a, b.file as b from le join ft a on a.id = le.src join ft b on b.id = le.dst where edge_type in ('imports', 'calls') and a.file <> b.file) "
        "select f.file, coalesce(i.n, 0) n_in, coalesce(o.n, 0) n_out, round(coalesce(i.n, 0) * 0.3::double + coalesce(o.n, 0) * 0.2::double, 6) coupling from (select distinct file from ft where node_type = 'file' and file is not null) f "
        "left join (select b, count(*) n from pr group by b) i on i.b = f.file left join (select a, count(*) n from pr group by a) o on o.a = f.file"
    ),
    "module_graph_nodes": sql(f", {_MOD} select grp as module, count(*) files from fm group by 1"),
    "module_graph_edges": sql(f", {_MOD} select * from me"),
    "pagerank_module": sql(f", {_MOD}, {_rank('me', '(select src as id from me union select dst from me)')} select id, round(rank, 8) as rank from pr"),
    "pagerank_nodes": sql(f", {_rank('le', 'cn')} select id, round(rank, 8) as rank from pr"),
    "cycle_nodes_module": sql(f", {_MOD}, rr(a, b) as (select src, dst from me union select rr.a, me.dst from rr join me on me.src = rr.b) select a as id from rr where a = b"),
    "degree_rank_topk": sql("select id, count(*) degree from (select src as id from le union all select dst from le) group by 1 order by 2 desc, 1 limit 20"),
    "layering_violations": sql(f", {_MOD} select * from me where contains(src, 'core') and contains(dst, 'view')"),
    "inherits_cross_file": sql("select b.name as base, count(distinct src) subclasses, count(distinct case when a.file_path <> b.file_path then src end) cross_file from le join cn a on a.id = src join cn b on b.id = dst where edge_type = 'inherits' group by 1"),
    "table_lineage": sql("select dst as id, count(distinct case when edge_type = 'reads' then src end) readers, count(distinct case when edge_type = 'writes' then src end) writers from le where edge_type in ('reads', 'writes') group by 1"),
    "repo_map_budget_cut": sql(f", {_rank('le', 'cn')}, {_MAP} select ms.repository, id, entry, cost, running from ms left join mo on mo.repository = ms.repository where (cut is null or rn < cut) and node_type in ('file', 'class', 'function', 'method')"),
    "trace_flow_edges": "select event_type as src, nt as dst, count(*) n from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) nt from events) where nt is not null group by 1, 2",
}
