"""Graph operators as frontier loops over DataFrames.

Edges are (src, dst). Every loop joins the frontier with an adjacency whose hot keys are spread over
salts, drops what was visited, and cuts the lineage by a checkpoint in the shared folder, so a lost executor
costs no more than a step. Null ends never match. Unknown roots are ignored where nodes are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .relational import running_sums

HOT, SALTS = 50_000, 16
TOLERANCE, ROUNDS, STEP = 1e-4, 100, 5  # of ranks


class Adjacency:
    """Distinct edges keyed by the end a traversal comes from; hot keys are spread over salts."""

    def __init__(self, edges: DataFrame, direction: str = "out", hot: int = HOT):
        pairs = edges.select("src", "dst")
        if direction == "in":
            pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        elif direction == "both":
            pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        pairs = pairs.where("src is not null and dst is not null").distinct().repartition("src").persist()
        # The pairs lie by src already: counting them moves nothing.
        self.hot = cut(pairs.groupBy("src").count().where(F.col("count") > hot).select(F.col("src").alias("hot")))
        self.any_hot = bool(self.hot.take(1))
        if self.any_hot:
            salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.lit(SALTS))).cast("int")
            plain = pairs
            pairs = plain.join(self.hot, F.col("src") == F.col("hot"), "left").select("src", "dst", salt.alias("salt")).repartition("src", "salt").persist()
            pairs.count()
            plain.unpersist()
        self.pairs = pairs

    def close(self) -> None:
        """Frees the cached pairs; what was computed from them is cut and stays."""
        self.pairs.unpersist()

    def step(self, frontier: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """Neighbours of ``frontier`` (id and carried columns): id, carried columns and ``via``."""
        kept = carry or []
        frontier = frontier.select(F.col("id").alias("src"), *kept)
        keys = ["src"]
        if self.any_hot:
            salts = F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            frontier = frontier.join(self.hot, F.col("src") == F.col("hot"), "left").withColumn("salt", F.explode(salts)).drop("hot")
            keys = ["src", "salt"]
        return self.pairs.join(frontier, keys).select(F.col("dst").alias("id"), F.col("src").alias("via"), *kept)


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """id and depth of everything reachable from ``roots`` (id), roots included at depth 0."""
    adjacency = Adjacency(edges, direction)
    seen = frontier = cut(roots.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = adjacency.step(frontier).select("id").distinct().join(seen.select("id"), "id", "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    adjacency.close()
    return seen


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members`` (id)."""
    ids = members.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_hops: int | None = 50, direction: str = "out", stop_at: str | None = None) -> DataFrame:
    """Per reached node the least hops from any source and the smallest such path (as an array from source to node).

    With ``stop_at`` the search ends in the round that reaches that node.
    """
    adjacency = Adjacency(edges, direction)
    seen = frontier = cut(sources.select("id").where("id is not null").distinct().select("id", F.lit(0).alias("hops"), F.array("id").alias("path")))
    hops = 0
    if stop_at is not None and seen.where(F.col("id") == stop_at).take(1):
        max_hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = adjacency.step(frontier, ["path"]).groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        frontier = cut(step.select("id", F.lit(hops).alias("hops"), F.concat("path", F.array("id")).alias("path")))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
        if stop_at is not None and frontier.where(F.col("id") == stop_at).take(1):
            break
    adjacency.close()
    return seen


def dependency_tree(edges: DataFrame, roots: DataFrame, depth: int = 2, direction: str = "out") -> DataFrame:
    """All paths down from the roots: root, path, depth, id, and ``recursive`` where a node repeats on its path (a leaf)."""
    adjacency = Adjacency(edges, direction)
    level = roots.select("id").distinct().select("id", F.array("id").alias("path"), F.lit(False).alias("recursive"))
    out = level = cut(level)
    for _ in range(depth):
        step = adjacency.step(level.where("not recursive"), ["path"])
        level = cut(step.select("id", F.concat("path", F.array("id")).alias("path"), F.array_contains("path", F.col("id")).alias("recursive")))
        if not level.take(1):
            break
        out = out.unionByName(level)
    adjacency.close()
    return out.select(F.element_at("path", 1).alias("root"), "id", (F.size("path") - 1).alias("depth"), "recursive", "path")


def pagerank(edges: DataFrame, ids: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE, rounds: int = ROUNDS, step: int = STEP) -> DataFrame:
    """id and rank (sum 1); parallel edges count; the mass of dead ends is spread evenly.

    Since that mass goes to all nodes alike, the ranks are in proportion to the solution of y = 1 + damping * came(y),
    which needs no sums on the driver. Rounds go on, ``step`` at a time, until the sum of what a step changes is less
    than ``tolerance`` of all, or ``rounds`` are done (what is left to change then is under damping ** rounds).
    """
    pairs = edges.select("src", "dst").where("src is not null and dst is not null")
    links = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    shares = cut(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    nodes = cut(ids.select("id").where("id is not null").distinct())
    shares = shares.join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").join(nodes.withColumnRenamed("id", "src"), "src", "left_semi")
    shares = cut(shares.repartition("src"))
    n = nodes.count()
    # y is 1 and what comes in, ``z``; of the 1 of every sender the same share comes each round (``steady``), so only
    # nodes that receive are carried from round to round.
    steady = cut(shares.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("v")))
    z = steady.select("id", F.lit(0.0).alias("z"))
    for _ in range(rounds // step):
        new = z.select("id", "z")
        for _ in range(step):
            came = shares.join(new.select(F.col("id").alias("src"), "z"), "src").select(F.col("dst").alias("id"), (F.col("z") * F.col("share")).alias("v"))
            new = came.unionByName(steady).groupBy("id").agg((damping * F.sum("v")).alias("z"))
        z = cut(new.join(z.select("id", F.col("z").alias("old")), "id").select("id", "z", F.abs(F.col("z") - F.col("old")).alias("change")))
        sums = z.agg(F.sum("change").alias("change"), F.sum("z").alias("all")).first()
        if (sums["change"] or 0.0) < tolerance * (n + (sums["all"] or 0.0)) or not n:
            break
    total = n + (z.agg(F.sum("z")).first()[0] or 0.0) or 1.0
    return nodes.join(z.select("id", "z"), "id", "left").select("id", ((1 + F.coalesce("z", F.lit(0.0))) / total).alias("rank"))


def contract(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between the groups (id, group) of their ends, each edge counted, those within one group left out."""
    g = groups.select("id", "group")
    return (
        edges.join(g.select(F.col("id").alias("src"), F.col("group").alias("a")), "src").join(g.select(F.col("id").alias("dst"), F.col("group").alias("b")), "dst")
        .where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))
    )


def trim(edges: DataFrame) -> DataFrame:
    """What remains of the edges when nodes without edges in or out are taken away until there are none."""
    left = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    n = left.count()
    while True:
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        m = left.count()
        if m == n:
            break
        n = m
    return left


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components that hold a cycle: id and component (its greatest id).

    Trimming, then colouring: the greatest id that reaches a node is its colour; what reaches back to that id
    within its colour is its component, and is taken out; the rest goes round again.
    """
    left = trim(edges)
    found = left.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    while left.take(1):
        colour = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("colour", F.col("id")))
        while True:
            came = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("c"))
            new = cut(colour.join(came, "id", "left").select("id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") > F.col("colour")).alias("moved")))
            colour = new.select("id", "colour")
            if not new.where("moved").take(1):
                break
        a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("cb"))
        inside = cut(left.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
        mine = reachable(inside, colour.where("id = colour").select("id"), direction="in").select("id")
        part = cut(colour.join(mine, "id").select("id", F.col("colour").alias("component")))
        held = part.join(inside.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
        sizes = held.groupBy("component").count().where("count > 1").select("component")
        loops = left.where("src = dst").select(F.col("src").alias("id")).distinct()
        found = cut(found.unionByName(held.join(sizes, "component", "left_semi").select("id", "component").union(part.join(loops, "id", "left_semi").select("id", "component")).distinct()))
        gone = part.select("id")
        left = trim(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """One cycle of each strongly connected component: component, hops and path.

    It is the shortest one through the component's greatest id, of several the smallest path; the path begins and
    ends with that id.
    """
    found = components(edges)
    inside = edges.select("src", "dst").distinct().join(found.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(found.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a = b")
    inside = cut(inside.select("src", "dst"))
    out = shortest_paths(inside, found.select(F.col("component").alias("id")).distinct(), None)
    back = out.select(F.col("id").alias("src"), "hops", "path", F.col("path")[0].alias("dst")).join(inside, ["src", "dst"])
    best = back.groupBy(F.col("dst").alias("component")).agg(F.min(F.struct("hops", "path")).alias("b"))
    return best.select("component", (F.col("b.hops") + 1).alias("hops"), F.concat("b.path", F.array("component")).alias("path"))


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree; a self-loop counts twice."""
    ends = F.explode(F.array("src", "dst")).alias("id")
    return edges.select(ends).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def path_edges(paths: DataFrame) -> DataFrame:
    """Adjacent pairs of each path: key, step, src, dst."""
    pairs = F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("pair")
    return paths.where("size(path) > 1").select("id", pairs).select("id", "pair.src", "pair.dst", F.lit("path").alias("edge_type"))


def budget_cut(rows: DataFrame, order: list[str], cost: str, budget: int, group: str, test: str | None = None) -> DataFrame:
    """Rows of each ``group`` before the first that overflows the budget, in ``order`` (ascending columns that tell them apart).

    ``cost`` is what a row adds, ``test`` (if another column) what must still fit. The running sum comes over range-cut
    slices, so no task holds a group whole. ``running`` is the sum with the row itself.
    """
    summed = cut(running_sums(rows, group, order, cost, "running"))
    over = F.col("running") - F.col(cost) + F.col(test or cost) > budget
    first = summed.where(over).groupBy(group).agg(F.min(F.struct(*order)).alias("_first"))
    kept = summed.join(first, group, "left")
    return kept.where(F.col("_first").isNull() | (F.struct(*order) < F.col("_first"))).drop("_first")
