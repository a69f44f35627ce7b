"""Link resolution: imports, calls and inheritance as prioritised equi-joins.

Names are aggregated to one row each (how many, and which) before anything is joined with them, so a name that
many symbols bear costs no pairs. Hot keys of the asking side are spread by ``skew_join``. Null names and paths
match nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .skew import skew_join

BLOCK = 64  # lines that share a key when spans are joined with lines


def path_index(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """key and target: each path by itself (``file:``), by the folders above it (``folder:``; the least path counts), and by its last segments (``end:``).

    ``modules``: root and module, the name under which a root's own Go packages are imported (``module:``).
    """
    rows = paths.select("path", F.split("path", "/").alias("p"), T.extension(F.col("path")).alias("ext")).withColumn("root", F.col("p")[0])
    itself = rows.select(F.concat(F.lit("file:"), "path").alias("key"), "path")
    rows = rows.where("size(p) > 1")
    upto = F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("folder")
    folders = rows.where(F.col("ext").isin("java", "kt", "kts", "go", "cs") & ~F.col("path").endswith("_test.go")).select("path", "root", F.when(F.col("ext").isin("kt", "kts"), "java").otherwise(F.col("ext")).alias("ext"), upto)
    own = folders.where("ext = 'go'").join(modules, "root").select(F.concat(F.lit("module:"), "root", F.lit("|"), "module", F.substr("folder", F.length("root") + 1)).alias("key"), "path")
    last = F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", -i, i), "/"))).alias("end")
    ends = rows.where(F.col("ext").isin("java", "kt", "kts", "cs")).select("path", "root", last).select(F.concat(F.lit("end:"), "root", F.lit("|"), "end").alias("key"), "path")
    folders = folders.select(F.concat(F.lit("folder:"), "ext", F.lit("|"), "folder").alias("key"), "path")
    return itself.unionByName(folders).unionByName(own).unionByName(ends).groupBy("key").agg(F.min("path").alias("target"))


def resolve_imports(imports: DataFrame, paths: DataFrame, modules: DataFrame) -> DataFrame:
    """Every import with the first of its ``candidates`` that is a file: all its columns and ``target`` (null: none here)."""
    asked = imports.select("path", "seq", F.posexplode("candidates").alias("prio", "key"))
    first = skew_join(asked, path_index(paths, modules), "key").groupBy("path", "seq").agg(F.min_by("target", "prio").alias("target"))
    return imports.drop("candidates").join(first, ["path", "seq"], "left")


def import_edges(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of resolved imports: path, seq, raw, target_file, imported_name, target, alias and kind.

    An imported name that the file has gives ``symbol`` (of several nodes the greatest ``node_seq``), one that it has
    not ``symbol_not_found``; everything at once gives ``star``; a module ``module`` with its alias. Of the last
    three the target is the file itself.
    """
    names = F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit(None).cast("string")))
    rows = resolved.where("target is not null").select("path", "seq", "raw", F.col("target").alias("target_file"), "aliases", "is_star", F.explode(names).alias("imported_name"))
    known = symbols.where("file_path is not null and name is not null").groupBy(F.col("file_path").alias("target_file"), F.col("name").alias("imported_name")).agg(F.max_by("id", "node_seq").alias("symbol"))
    linked = rows.join(known, ["target_file", "imported_name"], "left")
    kind = F.when(F.col("symbol").isNotNull(), "symbol").when(F.col("imported_name").isNotNull(), "symbol_not_found").when(F.col("is_star"), "star").otherwise("module")
    alias = F.col("aliases")[F.coalesce("imported_name", "raw")]
    return linked.select("path", "seq", "raw", "target_file", "imported_name", F.coalesce("symbol", F.concat(F.lit("file::"), "target_file")).alias("target"), alias.alias("alias"), kind.alias("kind"))


def meet(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Every point (path, line) with every span (path, first, last) around it; both keyed by blocks of lines."""
    blocks = spans.where("first >= 1 and last >= first").withColumn("_block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))))
    return points.withColumn("_block", F.floor(F.col("line") / BLOCK)).join(blocks, ["path", "_block"]).where("line between first and last").drop("_block")


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``points`` (path, line and others) with the first of the ``spans`` (path, first, last and others) around each in ``order``.

    ``keys`` tell the points apart. Spans are keyed by blocks of lines, so a point meets only spans that reach into
    its block; points in no span are left out.
    """
    own = [c for c in spans.columns if c != "path"]
    met = meet(points, spans)
    best = met.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in own if c not in order])).alias("_s"), *[F.first(c).alias(c) for c in points.columns if c not in keys])
    return best.select(*points.columns, *[F.col("_s")[c].alias(c) for c in own])


def calling_functions(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with the tightest function around them: path, seq, line, callee, receiver, source, class_name.

    A function's own heading is no call of it; calls outside functions are left out.
    """
    spans = functions.where("file_path is not null").select(F.col("file_path").alias("path"), F.col("line_start").alias("first"), F.col("line_end").alias("last"), F.col("id").alias("source"), F.col("name").alias("own_name"), "class_name")
    spans = spans.withColumn("size", F.col("last") - F.col("first"))
    held = enclosing(calls, spans, ["path", "seq"], ["size", "source"])
    return held.where(~((F.col("line") == F.col("first")) & (F.col("callee") == F.col("own_name")))).select("path", "seq", "line", "callee", "receiver", "source", "class_name")


def _unique(known: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` how many functions there are (``n``) and the least of them (``target``)."""
    return known.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("target"))


def resolve_calls(calls: DataFrame, functions: DataFrame, links: DataFrame) -> DataFrame:
    """source, callee, receiver, target and tier: the first tier that has one target.

    1 what the caller's file imports: a function of that name, else the one function of that name in an imported
    file, else there the first if the receiver is the file's alias, else the one whose class is the receiver; 2 the
    only function of that name; 3 the only one in the file; 4 the only one in a class called as the caller's; 5 the
    only one in a class called as the receiver. What none of them tells is dropped.
    ``links``: file, seq, symbol (a function's id) or at (a file), and alias.
    """
    asked = calls.select("source", "callee", "receiver", F.col("path").alias("file"), "class_name").distinct()
    known = functions.select("id", F.col("name").alias("callee"), F.col("file_path").alias("at"), F.col("class_name").alias("owner"))
    keys = ["source", "callee", "receiver"]
    named = known.select(F.col("id").alias("symbol"), "callee", F.col("id").alias("target"))
    symbols = links.where("symbol is not null").join(named, "symbol").groupBy("file", "callee").agg(F.min(F.struct("seq", "target")).alias("t"))
    direct = asked.join(symbols, ["file", "callee"]).select(*keys, F.lit(1).alias("tier"), F.col("t.seq").alias("seq"), F.col("t.target").alias("target"))

    in_file, in_class = _unique(known, ["at", "callee"]), _unique(known, ["at", "owner", "callee"])
    through = asked.join(links.where("at is not null").select("file", "at", "alias", "seq"), "file").join(in_file, ["at", "callee"])
    through = through.join(in_class.select("at", F.col("owner").alias("receiver"), "callee", F.col("n").alias("n_class"), F.col("target").alias("of_class")), ["at", "receiver", "callee"], "left")
    pick = F.when(F.col("n") == 1, F.col("target")).when(F.col("alias") == F.col("receiver"), F.col("target")).when(F.col("n_class") == 1, F.col("of_class"))
    through = through.select(*keys, F.lit(1).alias("tier"), "seq", pick.alias("target")).where("target is not null")

    def tier(number: int, on: list[str], table: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(table.where("n = 1").select(*on, "target"), on).select(*keys, F.lit(number).alias("tier"), F.lit(0).cast("long").alias("seq"), "target")

    of_class = _unique(known, ["owner", "callee"])
    only = skew_join(asked, _unique(known, ["callee"]).where("n = 1").select("callee", "target"), "callee").select(*keys, F.lit(2).alias("tier"), F.lit(0).cast("long").alias("seq"), "target")
    every = direct.unionByName(through).unionByName(only)
    every = every.unionByName(tier(3, ["file", "callee"], in_file.withColumnRenamed("at", "file"), asked))
    every = every.unionByName(tier(4, ["owner", "callee"], of_class, asked.withColumnRenamed("class_name", "owner")))
    every = every.unionByName(tier(5, ["owner", "callee"], of_class, asked.withColumn("owner", F.col("receiver"))))
    best = every.groupBy(*keys).agg(F.min(F.struct("tier", "seq", "target")).alias("t"))
    return best.select(*keys, "t.target", "t.tier")


def resolve_bases(classes: DataFrame, imports: DataFrame, inherits: DataFrame) -> DataFrame:
    """Every base of every class by its simple name: id, name, base (null: none known) and cross_file.

    A class of the same file comes first, else one in a file that the class's file imports (the least ``node_seq``);
    a base that the class inherits from already (``inherits``: src, name) is left out.
    """
    bases = classes.select("id", "file_path", F.explode("bases").alias("raw")).where("raw is not null").select("id", "file_path", F.element_at(F.split("raw", r"\.|::"), -1).alias("name")).distinct()
    bases = bases.join(inherits.select(F.col("src").alias("id"), "name").distinct(), ["id", "name"], "left_anti")
    known = classes.groupBy(F.col("file_path").alias("at"), "name").agg(F.min(F.struct("node_seq", "id")).alias("k"))
    near = bases.join(known, (bases["file_path"] == known["at"]) & (bases["name"] == known["name"])).where(F.col("k.id") != bases["id"]).select("id", bases["name"], F.lit(False).alias("cross_file"), "k")
    links = imports.where("src_file <> dst_file").select(F.col("src_file").alias("file_path"), F.col("dst_file").alias("at")).distinct()
    far = bases.join(links, "file_path").join(known, ["at", "name"]).select("id", "name", F.lit(True).alias("cross_file"), "k")
    best = near.unionByName(far).groupBy("id", "name").agg(F.min(F.struct("cross_file", "k")).alias("b"))
    return bases.join(best, ["id", "name"], "left").select("id", "name", F.col("b.k.id").alias("base"), F.col("b.cross_file").alias("cross_file"))
