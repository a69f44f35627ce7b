"""Hotspot axes of files, their calibration, and entrypoints."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.comments import comments
from ..operators import graph
from ..operators.relational import first_by, positions
from ..operators.resolve import meet
from ..schema import CONCURRENCY, ENTRY_DECORATORS, ENTRY_FILES, ENTRY_META, ENTRY_NAMES, LOGIC_LANGUAGE, LOGIC_WORDS, RISK, WEIGHTS
from ..sources.tables import table
from .base import edges, file_facts, file_rows, files, functions, nodes, sql
from .graph_queries import _rank, path_of

CHURN_STATES = 2  # states of a file from which churn counts
PERCENTILE, RATE, SAMPLE = 95, 0.05, 800
AXES = ["structural", "behavioral", "semantic", "graph"]  # those that calibration weighs
PROJECT_MARKS = {"@staticmethod": 0.5}  # a project's own decorators of entrypoints
# Findings told from a line, by the codes of common linters.
LINT = {
    "E501": r"^.{121,}", "W291": r"[^ \t][ \t]+$", "W293": r"^[ \t]+$", "E711": r"[=!]= *None\b", "E712": r"[=!]= *(?:True|False)\b", "E722": r"^[ \t]*except[ \t]*:", "E703": r"^[^#\"']*;[ \t]*$",
    "E731": r"^[ \t]*\w+ = lambda\b", "E401": r"^[ \t]*import \w[\w.]*, *\w", "W191": r"^ *\t",
}



def _code():
    """Extension and lines of code of ``content``: block comments and line comments are taken out, blank lines dropped."""
    ext = T.extension(F.col("relative_path"))
    # [\s\S] and not a dot: the block may span lines.
    bare = F.when(ext.isin("py", "rb"), F.regexp_replace("content", r"#[^\r\n]*", "")).when(ext == "sql", F.regexp_replace("content", r"--[^\r\n]*", "")).otherwise(F.regexp_replace(F.regexp_replace("content", r"/\*[\s\S]*?\*/", ""), r"//[^\r\n]*", ""))
    return {"ext": ext, "code": F.filter(T.lines(bare), lambda x: ~x.rlike(r"^[ \t]*$"))}


def _code_facts(spark, d, **facts):
    """path and facts about the lines of code (``code``) of each file that can be read."""
    rows = file_facts(spark, d, _code(), n_lines=F.size(T.lines(F.col("content"))), readable=F.col("content").isNotNull(), **facts)
    return rows.where("readable").withColumnRenamed("relative_path", "path")


def _depths():
    return F.transform("code", lambda x: F.floor((F.length(x) - F.length(F.regexp_replace(x, r"^[ \t]+", ""))) / 4).cast("int"))


def indent_depth(spark, d):
    """Deepest nesting and number of deep lines of each file, four columns a level."""
    rows = _code_facts(spark, d, max_depth=F.coalesce(F.array_max(_depths()), F.lit(0)), deep_lines=F.size(F.filter(_depths(), lambda x: x > 4)))
    return rows.select("path", "max_depth", "deep_lines", "n_lines")


def _word_hits():
    """Logic words in the lines of ``code``: a line counts each word it contains."""
    lists = F.create_map(*[x for e, language in LOGIC_LANGUAGE.items() for x in (F.lit(e), F.array(*[F.lit(w) for w in LOGIC_WORDS[language]]))])
    words = F.coalesce(lists[F.col("ext")], F.array().cast("array<string>"))
    return F.aggregate(F.transform("code", lambda x: F.size(F.filter(words, lambda w: F.contains(F.trim(x), w)))), F.lit(0), lambda a, x: a + x)


def _holds(text):
    return lambda x: F.lower(x).contains(text)


def keyword_density(spark, d):
    """Logic words per line of code: a line counts each word it contains."""
    rows = _code_facts(spark, d, hits=_word_hits(), n=F.size("code"))
    return rows.select("path", "hits", F.col("n").alias("code_lines"), F.round(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0), 6).alias("density"))


def regex_marker_hits(spark, d):
    rows = _code_facts(spark, d, concurrency=T.line_hits(F.col("code"), CONCURRENCY), risk=T.line_hits(F.col("code"), RISK))
    return rows.select("path", "concurrency", "risk")


_MARK = re.compile("TODO|FIXME|HACK", re.I)


def _marks(path: str, text: str) -> list[tuple[int, str]]:
    if not _MARK.search(text):
        return []
    return [(line, m.group().lower()) for line, said in comments(path, text) if (m := _MARK.search(said))]


def todo_comment_scan(spark, d):
    """Marked comments: path, line, kind and weight; the first mark of a comment's line counts, marks in strings do not."""
    rows = file_rows(spark, d, _marks, "line int, kind string").withColumnRenamed("relative_path", "path")
    return rows.withColumn("weight", F.when(F.col("kind") == "todo", WEIGHTS["todo"]).when(F.col("kind") == "fixme", WEIGHTS["fixme"]).otherwise(WEIGHTS["hack"]))


def lint(spark, d):
    """Findings in Python files, each line against each pattern of ``LINT``."""
    codes = lambda x: F.filter(F.array(*[F.when(x["text"].rlike(p), F.lit(c)) for c, p in LINT.items()]), lambda c: c.isNotNull())
    anything = "|".join(f"(?:{p})" for p in LINT.values())
    lines = F.filter(T.numbered(T.lines(F.col("content"))), lambda x: x["text"].rlike(anything))
    found = F.transform(lines, lambda x: F.struct(x["n"].alias("line"), codes(x).alias("codes")))
    rows = file_facts(spark, d, found=F.when(T.extension(F.col("relative_path")) == "py", found))
    return rows.select(F.col("relative_path").alias("path"), F.explode("found").alias("f")).select("path", "f.line", F.explode("f.codes").alias("code"))


def lint_structural_score(spark, d):
    return lint(spark, d).groupBy("path").agg(F.count("*").alias("findings"), F.sum(F.when(F.col("code").rlike("^[EF]"), WEIGHTS["error"]).otherwise(WEIGHTS["warning"])).alias("structural"))


def churn_window_count(spark, d):
    """States of each file, and the score where there are enough of them."""
    states = table(spark, d, "files").where("relative_path is not null and mtime > 0").groupBy(F.col("relative_path").alias("path")).agg(F.countDistinct("mtime").alias("n"))
    return states.select("path", "n", F.when(F.col("n") >= CHURN_STATES, F.col("n") * WEIGHTS["churn"]).otherwise(0.0).alias("behavioral"))


def events_churn(spark, d):
    """Events per user in the last seven days of the stream."""
    rows = table(spark, d, "events")
    last = rows.agg(F.max("ts")).first()[0]
    return rows.where(F.col("ts") >= F.lit(last) - F.expr("interval 7 days")).groupBy("user_id").agg(F.count("*").alias("n"))


def _file_links(spark, d):
    at = nodes(spark, d, "file_path", "relative_path").select("id", path_of().alias("file")).where("file is not null")
    e = edges(spark, d, "imports", "calls")
    return e.join(at.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def pagerank_files(spark, d):
    """Centrality of files: rank times the number of files that have a link, so the mean is 1."""
    links = graph.cut(_file_links(spark, d))
    ids = graph.cut(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct())
    n = ids.count()
    return graph.pagerank(links, ids).select(F.col("id").alias("path"), F.round(F.col("rank") * n, 6).alias("centrality"))


def axes(spark, d):
    """The six axes of every file and their sum."""
    # one pass over the code for all that is read from it
    facts = _code_facts(
        spark, d, n=F.size("code"), hits=_word_hits(), max_depth=F.coalesce(F.array_max(_depths()), F.lit(0)), deep=F.size(F.filter(_depths(), lambda x: x > 4)),
        conc=T.line_hits(F.col("code"), CONCURRENCY), risky=T.line_hits(F.col("code"), RISK),
    )
    logic = (
        F.when(F.col("n_lines") > 300, (F.col("n_lines") - 300) / 100).otherwise(0.0) + F.when(F.col("max_depth") > 5, (F.col("max_depth") - 4) * 0.5).otherwise(0.0)
        + F.when(F.col("deep") > 10, F.col("deep") * 0.1).otherwise(0.0) + F.when((F.col("n") > 10) & (F.col("hits") / F.col("n") > 0.15), (F.col("hits") / F.col("n") - 0.15) * 20).otherwise(0.0)
    )
    conc = F.when(F.col("conc") > 0, 1 + 0.1 * F.col("conc")).otherwise(0.0)
    complexity = logic * WEIGHTS["logic"] + conc * WEIGHTS["concurrency"]
    risk = F.when(F.col("risky") > 0, 0.5 + 0.2 * F.col("risky")).otherwise(0.0) * WEIGHTS["risk"]
    links = graph.cut(_file_links(spark, d))
    ins, outs = links.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("i")), links.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    every = files(spark, d, "mtime").select(F.col("relative_path").alias("path"))
    semantic = todo_comment_scan(spark, d).groupBy("path").agg(F.sum("weight").alias("semantic"))
    out = (
        every.join(facts.select("path", complexity.alias("complexity"), risk.alias("risk")), "path", "left").join(lint_structural_score(spark, d).select("path", "structural"), "path", "left")
        .join(semantic, "path", "left").join(churn_window_count(spark, d).select("path", "behavioral"), "path", "left")
        .join(ins, "path", "left").join(outs, "path", "left").join(pagerank_files(spark, d), "path", "left")
    )
    graph_axis = zero(F.col("i")) * WEIGHTS["in"] + zero(F.col("o")) * WEIGHTS["out"] + zero(F.col("centrality")) * WEIGHTS["centrality"]
    parts = {"structural": zero(F.col("structural")), "semantic": zero(F.col("semantic")), "behavioral": zero(F.col("behavioral")), "graph": graph_axis, "complexity": zero(F.col("complexity")), "risk": zero(F.col("risk"))}
    return out.select("path", *[F.round(c, 4).alias(n) for n, c in parts.items()], F.round(sum(parts.values(), F.lit(0.0)), 4).alias("total"))


def hotspot_total_report(spark, d):
    return axes(spark, d)


def hotspot_high(spark, d):
    return axes(spark, d).where(F.col("total") >= WEIGHTS["high"]).select("path", "total")


def hotspot_in_scope_semijoin(spark, d):
    """Scores of the files that some file imports."""
    imported = edges(spark, d, "imports").select(F.col("dst").alias("id")).distinct().select(F.regexp_replace("id", "^file::", "").alias("path"))
    return axes(spark, d).join(imported, "path", "left_semi").select("path", "total")


def hotspot_left_join_rank(spark, d):
    """Nodes with their degree and their file's churn score; unknown scores are -1."""
    ranked = graph.degrees(edges(spark, d)).join(nodes(spark, d, "file_path", "relative_path"), "id").select("id", "degree", path_of().alias("path"))
    scored = ranked.join(churn_window_count(spark, d).select("path", "behavioral"), "path", "left")
    icon = F.when(F.col("behavioral") > 1, "high").when(F.col("behavioral") > 0, "some").otherwise("none")
    return scored.select("id", "degree", F.coalesce("behavioral", F.lit(-1.0)).alias("score"), icon.alias("icon"))


def function_issue_rangejoin(spark, d):
    """Weights of findings and marked comments per function that holds their line."""
    issues = todo_comment_scan(spark, d).select("path", "line", F.col("weight").alias("semantic"), F.lit(0.0).alias("structural"))
    issues = issues.unionByName(lint(spark, d).select("path", "line", F.lit(0.0).alias("semantic"), F.when(F.col("code").rlike("^[EF]"), WEIGHTS["error"]).otherwise(WEIGHTS["warning"]).alias("structural")))
    spans = functions(spark, d, "file_path", "line_start", "line_end").where("line_start > 0 and line_end is not null").select("id", F.col("file_path").alias("path"), F.col("line_start").alias("first"), F.col("line_end").alias("last"))
    held = meet(issues, spans)
    return held.groupBy("id").agg(F.count("*").alias("issues"), F.sum("semantic").alias("semantic"), F.sum("structural").alias("structural"))


def axis_percentiles(spark, d):
    """Medians, 90th and 95th percentiles by linear interpolation."""
    rows = file_degrees(spark, d).unionByName(churn_window_count(spark, d).select(F.lit("churn").alias("axis"), "behavioral"))
    return rows.groupBy("axis").agg(*[F.round(F.percentile("behavioral", F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 90, 95)])


def file_degrees(spark, d):
    links = _file_links(spark, d)
    return links.groupBy("src").agg(F.count("*").cast("double").alias("behavioral")).select(F.lit("out").alias("axis"), "behavioral")


def calibration(spark, d):
    """What the distribution of scores recommends, over a stable sample of at most SAMPLE files.

    The threshold is the n-th largest total, n being the share RATE of the files; per axis its share of all totals
    and its percentile PERCENTILE by linear interpolation.
    """
    rows = axes(spark, d).withColumn("hash", F.sha2("path", 256)).withColumn("one", F.lit(1))
    rows = graph.cut(rows)
    total = rows.count()
    if total > SAMPLE:
        rows = positions(rows, "one", ["hash", "path"]).where((F.col("pos") - 1) % max(1, total // SAMPLE) == 0).orderBy("hash", "path").limit(SAMPLE)
    rows = graph.cut(rows.select("path", "total", *AXES))
    n = rows.count()
    take = max(1, int(n * RATE))
    every = F.sum("total")
    shares = [F.round(F.when(every > 0, F.sum(a) / every).otherwise(0.0), 6).alias(f"share_{a}") for a in AXES]
    marks = [F.round(F.percentile(a, F.lit(PERCENTILE / 100)), 2).alias(f"p_{a}") for a in AXES]
    nth = rows.orderBy(F.desc("total"), "path").limit(take).agg(F.round(F.min("total"), 2).alias("threshold"))  # of the sample, so bounded
    return rows.agg(F.count("*").alias("files"), *shares, *marks).join(nth, F.lit(True)).withColumn("n", F.lit(take).cast("long"))


def calibration_threshold(spark, d):
    """The n-th largest score of findings, n being the share RATE of all files that have any; no task sorts them whole."""
    scores = graph.cut(lint_structural_score(spark, d).select("path", "structural").withColumn("down", -F.col("structural")).withColumn("one", F.lit(1)))
    n = scores.count()
    take = max(1, int(n * RATE))
    placed = positions(scores, "one", ["down", "path"]).where(F.col("pos") == min(take, max(1, n)))
    return placed.select(F.col("structural").alias("threshold"), F.lit(take).cast("long").alias("n"), F.lit(n).cast("long").alias("files"))


def stable_hash_sample(spark, d):
    """Every step-th file in the order of the hash of its path, at most SAMPLE; the order is cut into ranges, not sorted in one task."""
    rows = table(spark, d, "files").where("relative_path is not null").select("relative_path").distinct().withColumn("hash", F.sha2("relative_path", 256)).withColumn("one", F.lit(1))
    rows = graph.cut(rows)
    step = max(1, rows.count() // SAMPLE)
    placed = positions(rows, "one", ["hash", "relative_path"]).where((F.col("pos") - 1) % step == 0)
    return placed.orderBy("hash", "relative_path").limit(SAMPLE).select("relative_path")


def _entrypoints(spark, d):
    """Candidates of three strategies; of one node the first strategy counts."""
    pick = lambda table_, key: F.coalesce(F.create_map(*[F.lit(x) for kv in table_.items() for x in kv])[key], F.lit(0.0))
    known = nodes(spark, d, "node_type", "name", "file_path", "relative_path", "decorators", "meta")
    by_file = known.where("node_type = 'file'").withColumn("base", pick(ENTRY_FILES, F.lower(T.basename(path_of())))).select("id", "base", F.lit(1).alias("prio"))
    named = known.where("node_type in ('function', 'method')")
    base = pick(ENTRY_NAMES, F.lower("name")) * F.when(F.col("node_type") == "method", 0.5).otherwise(1.0)
    at_main = F.lower("file_path").rlike(r"main\.py|app\.py|cli\.py")
    by_name = named.withColumn("base", F.when(at_main & (base > 0), F.least(F.lit(0.95), base + 0.3)).otherwise(base)).select("id", "base", F.lit(2).alias("prio"))
    marks = [F.when(F.exists(F.coalesce("decorators", F.array().cast("array<string>")), _holds(k)), v).otherwise(0.0) for k, v in (ENTRY_DECORATORS | PROJECT_MARKS).items()]
    metas = [F.when(F.coalesce(F.col("meta")[k], F.lit("false")).isin("true", "True", "1"), v).otherwise(0.0) for k, v in ENTRY_META.items()]
    by_mark = known.where("node_type in ('function', 'method', 'class')").withColumn("base", F.greatest(*marks, *metas)).select("id", "base", F.lit(3).alias("prio"))
    return first_by(by_file.unionByName(by_name).unionByName(by_mark).where("base > 0"), ["id"], [F.col("prio")])


def entrypoint_candidates(spark, d):
    return _entrypoints(spark, d).select("id", F.round("base", 6).alias("base"), F.col("prio").alias("strategy"))


def entrypoint_scores(spark, d):
    """Every candidate by 0.7 base + 0.3 min(1, reach / 100), the reach over calls within five steps, the node itself included."""
    return _scored_entrypoints(spark, d)


def _scored_entrypoints(spark, d):
    found = graph.cut(_entrypoints(spark, d).select("id", "base"))
    reach = _reach(edges(spark, d, "calls").select("src", "dst").distinct(), found)
    score = F.round(0.7 * F.col("base") + 0.3 * F.least(F.lit(1.0), F.col("reach") / 100), 6)
    return found.join(reach, "id").select("id", "reach", score.alias("score"))


def entrypoint_reach(spark, d):
    """How many nodes each uncalled function reaches over calls within five steps, itself included."""
    calls = graph.cut(edges(spark, d, "calls").select("src", "dst").distinct())
    uncalled = calls.select(F.col("src").alias("id")).distinct().join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return _reach(calls, uncalled)


def _reach(calls, starts):
    """Per id of ``starts`` the nodes within five calls, itself included."""
    adjacency = graph.Adjacency(calls)
    seen = frontier = graph.cut(starts.select(F.col("id").alias("root"), "id"))
    for _ in range(5):
        frontier = graph.cut(adjacency.step(frontier, ["root"]).select("root", "id").distinct().join(seen, ["root", "id"], "left_anti"))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    adjacency.close()
    return seen.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("reach"))


def entrypoint_scores_whole(spark, d):
    """The score of every candidate of ``entrypoint_candidates`` with its own base, and its place."""
    scored = _scored_entrypoints(spark, d).withColumn("one", F.lit(1)).withColumn("down", -F.col("score"))
    return positions(scored, "one", ["down", "id"], "place").select("id", "reach", "score", "place")


QUERIES = {
    f.__name__: f
    for f in (
        indent_depth, keyword_density, regex_marker_hits, todo_comment_scan, lint_structural_score, churn_window_count, events_churn, pagerank_files, hotspot_total_report, hotspot_high, hotspot_in_scope_semijoin,
        hotspot_left_join_rank, function_issue_rangejoin, axis_percentiles, calibration, calibration_threshold, stable_hash_sample, entrypoint_candidates, entrypoint_scores, entrypoint_scores_whole, entrypoint_reach,
    )
}


def _sql_lines(text: str) -> str:
    return rf"regexp_split_to_array(regexp_replace(regexp_replace({text}, '\r\n|\r', chr(10), 'g'), '\n$', ''), '\n')"


_EXT = r"lower(regexp_extract(relative_path, '\.([A-Za-z0-9]+)$', 1))"
_CODE = rf"""cl as (select relative_path as path, ext, list_filter({_sql_lines('bare')}, lambda x: not regexp_matches(x, '^[ \t]*$')) as code, len({_sql_lines('content')}) as n_lines from (
  select relative_path, content, {_EXT} as ext, case when {_EXT} in ('py', 'rb') then regexp_replace(content, '#[^\r\n]*', '', 'g') when {_EXT} = 'sql' then regexp_replace(content, '--[^\r\n]*', '', 'g')
    else regexp_replace(regexp_replace(content, '/\*[\s\S]*?\*/', '', 'g'), '//[^\r\n]*', '', 'g') end as bare from cf where content is not null))"""
_DEPTHS = r"list_transform(code, lambda x: cast(floor((length(x) - length(regexp_replace(x, '^[ \t]+', ''))) / 4) as integer))"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits_sql(patterns: list[str]) -> str:
    each = " + ".join(f"regexp_matches(x, {_quote(p)})::int * {patterns.count(p)}" for p in dict.fromkeys(patterns))
    return f"coalesce(list_sum(list_transform(code, lambda x: {each})), 0)"


def _words_sql() -> str:
    cases = []
    for language, words in LOGIC_WORDS.items():
        own = [e for e, name in LOGIC_LANGUAGE.items() if name == language]
        if own:
            each = " + ".join(f"contains(trim(x), {_quote(w)})::int" for w in words)
            cases.append(f"when ext in ({', '.join(map(_quote, own))}) then coalesce(list_sum(list_transform(code, lambda x: {each})), 0)")
    return "case " + " ".join(cases) + " else 0 end"


_STRINGS = """"(?:[^"\\\\\\n]|\\\\[\\s\\S])*"|''(?:[^''\\\\\\n]|\\\\[\\s\\S])*''"""


def _comment_sql() -> str:
    """cm(path, line, said): the lines of comments, from tokens (comment, string, run of other characters) with running line numbers."""
    long_ = '"""[\\s\\S]*?"""|' + r"''''''[\s\S]*?''''''"
    block = r"/\*[\s\S]*?\*/"
    scans = {"py": rf"#[^\n]*|{long_}|{_STRINGS}|[^#\"''\n]+|[\s\S]", "sql": rf"--[^\n]*|{block}|{_STRINGS}|[^-/\"''\n]+|[\s\S]", "c": rf"//[^\n]*|{block}|{_STRINGS}|`(?:[^`\\]|\\[\s\S])*`|[^/\"''`\n]+|[\s\S]"}
    family = f"case when {_EXT} = 'py' then 'py' when {_EXT} = 'sql' then 'sql' when {_EXT} in ('js', 'mjs', 'ts', 'java', 'c', 'h', 'cs', 'go', 'rs') then 'c' else '#' end"
    tokens = "case fam " + " ".join(f"when '{k}' then regexp_extract_all(t, '{v}')" for k, v in scans.items()) + " end"
    return rf"""src as (select relative_path as path, {family} as fam, regexp_replace(regexp_replace(content, '\r\n|\r', chr(10), 'g'), '^\x{{FEFF}}', '') as t from cf where regexp_matches(content, '(?i)TODO|FIXME|HACK')),
tk0 as (select path, fam, {tokens} as ts from src where fam <> '#'),
tk1 as (select path, fam, unnest(ts) as tok, generate_subscripts(ts, 1) as k from tk0),
tk2 as (select *, coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) over (partition by path order by k rows between unbounded preceding and 1 preceding), 0) as before_ from tk1),
cm0 as (select path, before_, string_split(regexp_replace(regexp_replace(tok, '^(?://|/\*|#+|--)', ''), '\*/$', ''), chr(10)) as parts from tk2 where (fam = 'py' and starts_with(tok, '#')) or (fam = 'sql' and (starts_with(tok, '--') or starts_with(tok, '/*'))) or (fam = 'c' and (starts_with(tok, '//') or starts_with(tok, '/*')))),
cm as (select path, cast(before_ + o as integer) as line, said from (select path, before_, unnest(parts) as said, generate_subscripts(parts, 1) as o from cm0)
  union all select path, cast(o as integer), regexp_extract(line_, '#([\s\S]*)$', 1) from (select path, unnest(ls) as line_, generate_subscripts(ls, 1) as o from (select path, string_split(t, chr(10)) as ls from src where fam = '#')) where contains(line_, '#') and not (o = 1 and starts_with(line_, '#!')))"""


_TODO = rf"""{_comment_sql()},
td as (select path, line, kind, case kind when 'todo' then {WEIGHTS['todo']}::double when 'fixme' then {WEIGHTS['fixme']}::double else {WEIGHTS['hack']}::double end as weight
  from (select path, line, lower(regexp_extract(said, '(?i)(TODO|FIXME|HACK)', 1)) as kind from cm where regexp_matches(said, '(?i)TODO|FIXME|HACK')))"""
_LINT = rf"""li as (select path, line, unnest(codes) as code from (select path, line, list_filter([{", ".join("case when regexp_matches(text, '" + p.replace("'", "''") + "') then '" + c + "' end" for c, p in LINT.items())}], lambda x: x is not null) as codes from (
  select relative_path as path, unnest(ls) as text, cast(generate_subscripts(ls, 1) as integer) as line from (select relative_path, {_sql_lines('content')} as ls from cf where {_EXT} = 'py' and content is not null)))),
ls as (select path, count(*) as findings, sum(case when regexp_matches(code, '^[EF]') then {WEIGHTS['error']}::double else {WEIGHTS['warning']}::double end) as structural from li group by 1)"""
_CHURN = f"ch as (select relative_path as path, count(distinct mtime) as n, case when count(distinct mtime) >= {CHURN_STATES} then count(distinct mtime) * {WEIGHTS['churn']}::double else 0.0::double end as behavioral from files where relative_path is not null and mtime > 0 group by 1)"
_LINKS = "ft as (select id, coalesce(relative_path, file_path) as file from cn where coalesce(relative_path, file_path) is not null), fl as (select distinct a.file as src, b.file as dst from le join ft a on a.id = le.src join ft b on b.id = le.dst where edge_type in ('imports', 'calls') and a.file <> b.file)"
_FILE_RANK = f"{_LINKS}, {_rank('fl', '(select src as id from fl union select dst from fl)')}, fr as (select id as path, round(rank * (select count(*) from pi), 6) as centrality from pr)"
_AXES = f"""{_CODE}, {_TODO}, {_LINT}, {_CHURN}, {_FILE_RANK},
fa as (select path, n_lines, len(code) as n, {_words_sql()} as hits, coalesce(list_max({_DEPTHS}), 0) as max_depth, len(list_filter({_DEPTHS}, lambda x: x > 4)) as deep, {_hits_sql(CONCURRENCY)} as conc, {_hits_sql(RISK)} as risky from cl),
fx as (select path,
  (case when n_lines > 300 then (n_lines - 300) / 100 else 0.0::double end + case when max_depth > 5 then (max_depth - 4) * 0.5::double else 0 end + case when deep > 10 then deep * 0.1::double else 0 end
   + case when n > 10 and hits / n > 0.15 then (hits / n - 0.15::double) * 20 else 0 end) * {WEIGHTS['logic']}::double + case when conc > 0 then 1 + 0.1::double * conc else 0 end * {WEIGHTS['concurrency']}::double as complexity,
  case when risky > 0 then 0.5::double + 0.2::double * risky else 0 end * {WEIGHTS['risk']}::double as risk from fa),
ax as (select f.relative_path as path, coalesce(structural, 0) as structural, coalesce(semantic, 0) as semantic, coalesce(behavioral, 0) as behavioral,
  coalesce(i.n, 0) * {WEIGHTS['in']}::double + coalesce(o.n, 0) * {WEIGHTS['out']}::double + coalesce(centrality, 0) * {WEIGHTS['centrality']}::double as graph, coalesce(complexity, 0) as complexity, coalesce(risk, 0) as risk
  from cf f left join fx on fx.path = f.relative_path left join ls on ls.path = f.relative_path left join (select path, sum(weight) as semantic from td group by 1) s on s.path = f.relative_path left join ch on ch.path = f.relative_path
  left join (select dst, count(*) n from fl group by 1) i on i.dst = f.relative_path left join (select src, count(*) n from fl group by 1) o on o.src = f.relative_path left join fr on fr.path = f.relative_path),
at2 as (select path, round(structural, 4) as structural, round(semantic, 4) as semantic, round(behavioral, 4) as behavioral, round(graph, 4) as graph, round(complexity, 4) as complexity, round(risk, 4) as risk,
  round(structural + semantic + behavioral + graph + complexity + risk, 4) as total from ax)"""
_DECO = "greatest(" + ", ".join([f"case when len(list_filter(coalesce(decorators, []), lambda x: contains(lower(x), '{k}'))) > 0 then {v} else 0.0 end" for k, v in (ENTRY_DECORATORS | PROJECT_MARKS).items()] + [f"case when coalesce(meta['{k}'], 'false') in ('true', 'True', '1') then {v} else 0.0 end" for k, v in ENTRY_META.items()]) + ")"
_NAMED = "case lower(name) " + " ".join(f"when '{k}' then {v}" for k, v in ENTRY_NAMES.items()) + " else 0.0 end * case when node_type = 'method' then 0.5 else 1.0 end"
_FILED = "case lower(regexp_extract(coalesce(relative_path, file_path), '([^/]*)$', 1)) " + " ".join(f"when '{k}' then {v}" for k, v in ENTRY_FILES.items()) + " else 0.0 end"

_CANDIDATES = f"c3 as (select id, {_FILED} base, 1 prio from cn where node_type = 'file' union all select id, case when b > 0 and regexp_matches(lower(file_path), 'main\\.py|app\\.py|cli\\.py') then least(0.95, b + 0.3) else b end, 2 from (select *, {_NAMED} b from cn where node_type in ('function', 'method')) union all select id, {_DECO}, 3 from cn where node_type in ('function', 'method', 'class')), ep as (select id, base, prio from (select *, row_number() over (partition by id order by prio) rn2 from c3 where base > 0) where rn2 = 1)"


def _reached(starts: str) -> str:
    return f"ce2 as (select distinct src, dst from le where edge_type = 'calls'), w(root, id, k) as (select id, id, 0 from {starts} union select w.root, ce2.dst, k + 1 from w join ce2 on ce2.src = w.id where k < 5), wr as (select root as id, count(distinct id) reach from w group by 1)"


_SCORED = f"{_CANDIDATES}, {_reached('ep')}, sc as (select ep.id, reach, round(0.7 * base + 0.3::double * least(1.0, reach / 100), 6)::double score from ep join wr using (id))"

ORACLES = {
    "indent_depth": sql(f", {_CODE} select path, cast(coalesce(list_max({_DEPTHS}), 0) as integer) max_depth, cast(len(list_filter({_DEPTHS}, lambda x: x > 4)) as integer) deep_lines, cast(n_lines as integer) n_lines from cl"),
    "keyword_density": sql(f", {_CODE} select path, cast(hits as integer) hits, cast(n as integer) code_lines, round(case when n > 0 then hits / n else 0.0 end, 6) density from (select path, {_words_sql()} as hits, len(code) as n from cl)"),
    "regex_marker_hits": sql(f", {_CODE} select path, cast({_hits_sql(CONCURRENCY)} as integer) concurrency, cast({_hits_sql(RISK)} as integer) risk from cl"),
    "todo_comment_scan": sql(f", {_TODO} select * from td"),
    "lint_structural_score": sql(f", {_LINT} select * from ls"),
    "churn_window_count": f"with {_CHURN} select * from ch",
    "events_churn": "select user_id, count(*) n from events where ts >= (select max(ts) from events) - interval 7 days group by 1",
    "pagerank_files": sql(f", {_FILE_RANK} select * from fr"),
    "hotspot_total_report": sql(f", {_AXES} select * from at2"),
    "hotspot_high": sql(f", {_AXES} select path, total from at2 where total >= {WEIGHTS['high']}"),
    "hotspot_in_scope_semijoin": sql(f", {_AXES} select path, total from at2 where path in (select regexp_replace(dst, '^file::', '') from le where edge_type = 'imports')"),
    "hotspot_left_join_rank": sql(f", {_CHURN}, dg as (select id, count(*) degree from (select src as id from le union all select dst from le) group by 1) select id, degree, coalesce(behavioral, -1.0)::double as score, case when behavioral > 1 then 'high' when behavioral > 0 then 'some' else 'none' end as icon from dg join cn using (id) left join ch on ch.path = coalesce(relative_path, file_path)"),
    "function_issue_rangejoin": sql(f", {_TODO}, {_LINT}, iss as (select path, line, weight as semantic, 0.0::double as structural from td union all select path, line, 0.0::double, case when regexp_matches(code, '^[EF]') then {WEIGHTS['error']}::double else {WEIGHTS['warning']}::double end from li) select id, count(*) issues, sum(semantic) semantic, sum(structural) structural from iss join cn on cn.file_path = iss.path and line between line_start and line_end where node_type in ('function', 'method') and line_start > 0 group by 1"),
    "axis_percentiles": sql(f", {_CHURN}, {_LINKS}, x as (select 'out' as axis, count(*)::double as v from fl group by src union all select 'churn', behavioral from ch) select axis, round(quantile_cont(v, 0.5), 6) p50, round(quantile_cont(v, 0.9), 6) p90, round(quantile_cont(v, 0.95), 6) p95 from x group by 1"),
    "calibration_threshold": sql(f", {_LINT}, k as (select greatest(1, cast(floor(count(*) * {RATE}) as bigint)) n, count(*) files from ls) select min(structural) threshold, max(n) n, max(files) files from (select structural, row_number() over (order by structural desc, path) rn from ls), k where rn <= n"),
    "stable_hash_sample": f"select relative_path from (select relative_path, h, row_number() over (order by h, relative_path) - 1 p, greatest(1, count(*) over () // {SAMPLE}) step from (select distinct relative_path, sha256(relative_path) h from files where relative_path is not null)) where p % step = 0 order by h, relative_path limit {SAMPLE}",
    "entrypoint_candidates": sql(f", {_CANDIDATES} select id, round(base, 6)::double base, prio as strategy from ep"),
    "entrypoint_scores": sql(f", {_SCORED} select id, reach, score from sc"),
    "entrypoint_scores_whole": sql(f", {_SCORED} select id, reach, score, cast(row_number() over (order by -score, id) as integer) place from sc"),
    "entrypoint_reach": sql(f", {_reached('(select distinct src as id from le where edge_type = %r and src not in (select dst from le where edge_type = %r))' % ('calls', 'calls'))} select id, reach from wr"),
    "calibration": sql(f", {_AXES}, sm as (select * from (select *, row_number() over (order by sha256(path), path) - 1 as p, count(*) over () as n from at2) where n <= {SAMPLE} or p % greatest(1, n // {SAMPLE}) = 0 order by sha256(path), path limit {SAMPLE}), nn as (select greatest(1, cast(floor(count(*) * {RATE}) as bigint)) n from sm) "
        "select count(*) files, " + ", ".join(f"round(sum({a}) / sum(total), 6) share_{a}, round(quantile_cont({a}, {PERCENTILE / 100}), 2) p_{a}" for a in AXES) + ", (select round(min(total), 2) from (select total, row_number() over (order by total desc, path) rn from sm), nn where rn <= n) threshold, (select n from nn) n from sm"),
}
