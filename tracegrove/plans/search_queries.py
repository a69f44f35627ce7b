"""Search by name, text and vector; fusion and routing."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.relational import first_by, positions
from ..session import cut
from ..sources.tables import table
from .base import file_facts, nodes, sql

NAME, TEXT, PREFER, REPOSITORY = "record", "retry", "class", "harborline"
K = 10  # neighbours
CHUNK, BLOCK = 50_000, 4_000  # rows and query vectors that meet in one task


def _ranked(spark, d, query):
    """Matching nodes, exact names first, then in the order in which names and nodes first came."""
    found = nodes(spark, d, "name", "node_type", "file_path", "node_seq").where(F.lower("name").contains(query.lower()))
    first = found.groupBy(F.lower("name").alias("low")).agg(F.min("node_seq").alias("first_seq"))
    return found.withColumn("low", F.lower("name")).join(first, "low").withColumn("exact", (F.col("low") == query.lower()).cast("int"))


def name_search(spark, d):
    return _ranked(spark, d, NAME).orderBy(F.desc("exact"), "first_seq", "node_seq").limit(10).select("id", "name", "node_type", "exact")


def name_search_functions(spark, d):
    return _ranked(spark, d, NAME).where("node_type in ('function', 'method')").orderBy(F.desc("exact"), "first_seq", "node_seq").limit(10).select("id", "name")


def resolve_symbol_scores(spark, d):
    """Score 1 for the name itself, 0.8 for a part of it, 0.2 more for the preferred type."""
    score = F.round(F.when(F.col("name") == NAME, 1.0).otherwise(0.8) + F.when(F.col("node_type") == PREFER, 0.2).otherwise(0.0), 6)
    return _ranked(spark, d, NAME).withColumn("score", score).orderBy(F.desc("score"), "first_seq", "node_seq").limit(10).select("id", "name", "score")


def search_path_prefix(spark, d):
    return _ranked(spark, d, NAME).where(F.col("file_path").startswith(f"{REPOSITORY}/")).orderBy(F.desc("exact"), "first_seq", "node_seq").limit(10).select("id", "name", "file_path")


def _hits(text):
    """Lines of the content that hold the text, with their numbers; null where there are none."""
    own = F.filter(T.numbered(T.lines(F.col("content"))), lambda x: F.lower(x["text"]).contains(text))
    return F.when(F.lower("content").contains(text), own)


def grep_documents(spark, d):
    """The first fifty lines, by file and line, that hold the text."""
    rows = file_facts(spark, d, hits=_hits(TEXT)).select("relative_path", F.explode("hits").alias("h"))
    return rows.select("relative_path", F.col("h.n").alias("line_no"), F.regexp_replace("h.text", r"^[ \t]+|[ \t]+$", "").alias("line")).orderBy("relative_path", "line_no").limit(50)


def grep_counts(spark, d):
    """Lines that hold the text, per repository, over all files."""
    rows = file_facts(spark, d, n=F.size(_hits(TEXT)).cast("long")).where("n > 0")
    return rows.groupBy(F.split("relative_path", "/")[0].alias("repository")).agg(F.sum("n").alias("n"))


def _nearest(rows, queries, k, metric, but_itself=True):
    """Exact k nearest rows of each query vector, without the query itself if so wished, in one job.

    Rows lie in chunks and queries in blocks by a hash of their id; every block meets every chunk in a task of its
    own, which holds ``CHUNK`` rows and ``BLOCK`` queries at most about. It keeps the k best of its rows per query, and
    one window merges them. Distances equal to six places are told apart by the id at every cut, so rows and ranks
    do not depend on how the table is split. Null vectors are left out; several rows of one id are all neighbours.
    """
    shape = "query_id long, vec_id long, d double, r double"
    rows = rows.where("embedding is not null").select("vec_id", "embedding")
    queries = queries.where("embedding is not null").select("vec_id", "embedding")
    n_rows, n_queries = rows.count(), queries.count()
    chunks, blocks = max(4, -(-n_rows // CHUNK)), max(1, -(-n_queries // BLOCK))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("chunk", part(chunks)).withColumn("block", each(blocks))
    right = queries.withColumn("block", part(blocks)).withColumn("chunk", each(chunks))

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        kept = [pd.DataFrame({"query_id": [], "vec_id": [], "d": [], "r": []})]
        if len(own) and len(asked):
            mine, m = own["vec_id"].to_numpy(), np.array(own["embedding"].tolist(), np.float64)
            ids, vectors = asked["vec_id"].to_numpy(), np.array(asked["embedding"].tolist(), np.float64)
            for a in range(0, len(ids), 64):
                q = vectors[a : a + 64]
                if metric == "l2":
                    dist = np.stack([((m - x) ** 2).sum(axis=1) for x in q])
                else:
                    norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :]
                    dist = -np.divide(q @ m.T, norm, out=np.zeros((len(q), len(m))), where=norm > 0)
                if but_itself:
                    dist[ids[a : a + 64][:, None] == mine[None, :]] = np.inf
                kept.append(_nearest_of(ids[a : a + 64], mine, dist, k))
        return pd.concat(kept[1:] or kept)

    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(best, shape)
    w = Window.partitionBy("query_id").orderBy("r", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest_of(ids, mine, dist, k: int) -> pd.DataFrame:
    """Per row of ``dist`` (queries by vectors) the k least by distance to six places, halves away from zero, then id."""
    r = np.trunc(dist * 1e6 + np.copysign(0.5, dist)) / 1e6 + 0.0
    near = np.isfinite(r)
    if len(mine) > k:
        near &= r <= np.partition(r, k - 1, axis=1)[:, k - 1 : k]
    q, at = np.nonzero(near)
    order = np.lexsort((mine[at], r[q, at], q))
    q, at = q[order], at[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, at = q[keep], at[keep]
    return pd.DataFrame({"query_id": ids[q], "vec_id": mine[at], "d": dist[q, at], "r": r[q, at]})


def knn_l2_topk(spark, d):
    rows = table(spark, d, "embeddings")
    found = _nearest(rows, rows.where("vec_id % 100 = 0"), K, "l2")
    return found.select("query_id", "vec_id", "rank", F.round("d", 4).alias("distance"), F.round(1 / (1 + F.col("d")), 5).alias("score"))


def knn_filtered_type(spark, d):
    """The filter comes before the search."""
    rows = table(spark, d, "embeddings")
    found = _nearest(rows.where("label % 2 = 0"), rows.where("vec_id % 100 = 0"), K, "l2")
    return found.select("query_id", "vec_id", "rank", F.round("d", 4).alias("distance"))


def cosine_router(spark, d):
    """Each query vector's most similar label centroid, if the similarity reaches the threshold."""
    rows = table(spark, d, "embeddings").where("embedding is not null")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    found = _nearest(centres.select(F.col("label").cast("long").alias("vec_id"), F.col("centre").alias("embedding")), rows.where("vec_id % 100 = 0"), 1, "cosine", but_itself=False)
    return found.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("label"), F.round(-F.col("d"), 6).alias("score")).where("score >= 0.1")


def token_overlap_router(spark, d):
    """Threads routed by their title: the first intent of which it holds a phrase (0.9), else the one that shares most words.

    The share is of the title's words of three characters or more, at least six; below 0.12 there is none. Of equal
    shares the first intent counts.
    """
    title = F.lower(F.coalesce("title", F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(title, F.lit("[a-z0-9_]{3,}"), F.lit(0)))
    rows = _threads(spark, d).select("id", title.alias("title"), words.alias("words"))
    phrase = F.lit(None).cast("string")
    for phrases, intent in reversed(PHRASES):
        holds = F.lit(False)
        for p in phrases:
            holds = holds | F.contains("title", F.lit(p))
        phrase = F.when(holds, intent).otherwise(phrase)
    options = [F.struct((F.size(F.array_intersect("words", F.array(*map(F.lit, intent_words(name))))) / F.greatest(F.lit(6.0), F.size("words"))).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("intent")) for i, name in enumerate(INTENTS)]
    best = F.greatest(*options)
    score = F.when(F.col("phrase").isNotNull(), 0.9).otherwise(best["score"])
    rows = rows.withColumn("phrase", phrase)
    return rows.select("id", F.when(F.col("phrase").isNotNull(), F.col("phrase")).when(best["score"] >= 0.12, best["intent"]).otherwise("none").alias("intent"), F.round(score, 6).alias("score"))


def token_overlap_router_whole(spark, d):
    """How many threads go to each intent."""
    return token_overlap_router(spark, d).groupBy("intent").agg(F.count("*").alias("threads"))


def intent_words(name: str) -> list[str]:
    """The words of an intent's name and description that tell something."""
    return sorted(set(re.findall("[a-z0-9_]{3,}", f"intent.{name} {INTENTS[name]}")) - STOP)


def _threads(spark, d):
    from .chat_queries import threads

    return threads(spark, d)


# Phrases that settle the intent, in order, and words that do not count.
PHRASES = [
    (("dead code", "unused", "unreachable"), "dead_code"), (("impact", "blast radius", "what breaks"), "change_impact"), (("dependency tree", "depends on"), "graph_dependency_tree"),
    (("dependency path", "path between", "between"), "graph_path"), (("hotspot", "tension", "risk"), "hotspots_report"), (("overview", "repo map", "structure"), "codebase_overview"),
    (("security", "auth", "cors", "token"), "security_review"), (("refactor", "cleanup"), "refactor_guidance"), (("architecture", "layering", "cycles"), "architecture_consistency"),
    (("capabilities", "what can you do", "tools"), "mcp_capabilities"), (("find symbol", "definition of", "where is"), "symbol_lookup"),
]
STOP = frozenset("the and for with from into that this your you are how what when where".split())
# What the intents are asked for.
INTENTS = {
    "architecture_consistency": "architecture consistency layering cycles boundary violations",
    "change_impact": "what breaks impact change of if change caller",
    "change_plan": "plan roadmap next phase priorities technical",
    "codebase_overview": "codebase overview repository structure summary",
    "dead_code": "unused dead code never called remove",
    "debug_troubleshoot": "why does fail error debug stale broken trace question",
    "entrypoints_callgraph": "entrypoints call graph callgraph starting project",
    "execution_graph_dynamic": "runtime traces dynamic execution scenario trace",
    "execution_graph_static": "static execution graph calls happens run feature",
    "feature_slice": "feature slice related functions code handles",
    "graph_dependency_tree": "dependency tree dependencies inbound outbound depends",
    "graph_path": "path between from to how reach",
    "hotspots_report": "hotspots risky complex slow files fail",
    "mcp_capabilities": "capabilities tools intents available list mcp",
    "refactor_guidance": "refactor guidance refactoring clean split review",
    "security_review": "security review authentication authorization secrets exposure",
    "symbol_lookup": "where is find show docs for symbol",
}


def seed_fusion_full_outer(spark, d):
    """Names found in text search and in vector-like search: semantic score, 0.5 more if also found by name."""
    lexical = _ranked(spark, d, NAME).select("id").distinct().withColumn("lex", F.lit(True))
    docs = nodes(spark, d, "docstring", "node_type").where(F.lower("docstring").contains(NAME))
    hits = F.size(F.split(F.lower("docstring"), NAME)) - 1
    semantic = docs.select("id", F.least(F.lit(0.9), 0.3 + 0.1 * hits).alias("sem"))
    fused = semantic.join(lexical, "id", "full_outer")
    score = F.round(F.coalesce("sem", F.lit(0.0)) + F.when(F.col("lex"), 0.5).otherwise(0.0), 6)
    return fused.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(50)


def snippet_normalise(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.snippet(F.col("text"), 80).alias("snippet")).where("length(snippet) > 0").groupBy("snippet").agg(F.count("*").alias("n")).where("n > 1")


def mermaid_safe_ids(spark, d):
    return nodes(spark, d, "name").select(T.mermaid_id(F.col("name")).alias("safe")).groupBy("safe").agg(F.count("*").alias("n"))


def context_for_query(spark, d):
    """Nodes whose name or docstring holds the query, until a budget of 512 tokens overflows."""
    from ..operators.graph import budget_cut

    found = nodes(spark, d, "name", "docstring", "node_seq").where(F.lower("name").contains(NAME) | F.lower("docstring").contains(NAME)).orderBy("node_seq").limit(10)
    cost = F.floor(F.length(F.concat_ws(": ", "name", "docstring")) / 4)
    return budget_cut(found.withColumn("cost", cost).withColumn("one", F.lit(1)), ["node_seq"], "cost", 512, "one").select("id", "cost", "running")


def dedupe_first_strategy(spark, d):
    """Per name the node that the first strategy finds: class, then function, then method."""
    order = F.when(F.col("node_type") == "class", 1).when(F.col("node_type") == "function", 2).otherwise(3)
    found = nodes(spark, d, "name", "node_type", "node_seq").where("node_type in ('class', 'function', 'method') and name is not null").withColumn("prio", order)
    return first_by(found, ["name"], [F.col("prio"), F.col("node_seq")]).select("name", "id", "node_type")


QUERIES = {
    f.__name__: f
    for f in (name_search, name_search_functions, resolve_symbol_scores, search_path_prefix, grep_documents, grep_counts, knn_l2_topk, knn_filtered_type, cosine_router, token_overlap_router, token_overlap_router_whole, seed_fusion_full_outer, snippet_normalise, mermaid_safe_ids, context_for_query, dedupe_first_strategy)
}

_RANK = f", nm as (select *, min(node_seq) over (partition by lower(name)) first_seq, case when lower(name) = '{NAME}' then 1 else 0 end as exact from cn where contains(lower(name), '{NAME}'))"
_LINES = r"regexp_split_to_array(regexp_replace(regexp_replace({0}, '\r\n|\r', chr(10), 'g'), '\n$', ''), '\n')"


def _knn(where: str) -> str:
    return f"""select query_id, vec_id, cast(rank as integer) as rank, round(d, 4) as distance{{0}} from (
        select *, row_number() over (partition by query_id order by round(d, 6), vec_id) rank from (
          select q.vec_id query_id, e.vec_id, list_sum(list_transform(list_zip(q.embedding::double[], e.embedding::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) d
          from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0 and {where})) where rank <= {K}"""


def _route() -> str:
    phrase = "case " + " ".join("when " + " or ".join(f"contains(t, '{p}')" for p in phrases) + f" then '{intent}'" for phrases, intent in PHRASES) + " end"
    shares = " union all ".join(f"select id, {i} as o, '{name}' as intent, len(list_intersect(w, {intent_words(name)})) / greatest(6.0, len(w)) as score from w" for i, name in enumerate(INTENTS))
    return f"""th as (select * from (select *, row_number() over (partition by id order by updated_at desc) rn from chat_threads) where rn = 1 and deleted_at is null),
w as (select id, lower(coalesce(title, '')) as t, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9_]{{3,}}')) as w from th), ph as (select id, {phrase} as phrase from w), s as ({shares}),
b as (select * from (select *, row_number() over (partition by id order by score desc, o) rn from s) where rn = 1),
rt as (select id, case when phrase is not null then phrase when score >= 0.12 then intent else 'none' end as intent, round(case when phrase is not null then 0.9 else score end, 6)::double as score from b join ph using (id))"""


_COS = """with r as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as x from embeddings where embedding is not null),
c as (select label, i, avg(x) as x from r group by 1, 2), n as (select label, sqrt(sum(x * x)) as n from c group by 1),
q as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as x from embeddings where vec_id % 100 = 0),
qn as (select vec_id, sqrt(sum(x * x)) as n from q group by 1),
s as (select vec_id, label, sum(q.x * c.x) as dp from q join c using (i) group by 1, 2),
t as (select vec_id, label, dp / (qn.n * n.n) as s from s join qn using (vec_id) join n using (label))
select vec_id, cast(label as bigint) as label, round(s, 6) as score from (select *, row_number() over (partition by vec_id order by round(-s, 6), label) as rn from t) where rn = 1 and round(s, 6) >= 0.1"""

ORACLES = {
    "cosine_router": _COS,
    "name_search": sql(f"{_RANK} select id, name, node_type, exact from nm order by exact desc, first_seq, node_seq limit 10"),
    "name_search_functions": sql(f"{_RANK} select id, name from nm where node_type in ('function', 'method') order by exact desc, first_seq, node_seq limit 10"),
    "resolve_symbol_scores": sql(f"{_RANK} select id, name, round(case when name = '{NAME}' then 1.0 else 0.8 end + case when node_type = '{PREFER}' then 0.2 else 0.0 end, 6)::double score from nm order by score desc, first_seq, node_seq limit 10"),
    "search_path_prefix": sql(f"{_RANK} select id, name, file_path from nm where starts_with(file_path, '{REPOSITORY}/') order by exact desc, first_seq, node_seq limit 10"),
    "grep_documents": sql(f", l as (select relative_path, {_LINES.format('content')} ls from cf where contains(lower(content), '{TEXT}')), e as (select relative_path, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from l) select relative_path, cast(line_no as integer) line_no, regexp_replace(line, '^[ \\t]+|[ \\t]+$', '', 'g') as line from e where contains(lower(line), '{TEXT}') order by relative_path, line_no limit 50"),
    "grep_counts": sql(f", l as (select relative_path, {_LINES.format('lower(content)')} ls from cf where contains(lower(content), '{TEXT}')) select split_part(relative_path, '/', 1) repository, cast(sum(len(list_filter(ls, lambda x: contains(x, '{TEXT}')))) as bigint) n from l group by 1"),
    "knn_l2_topk": _knn("true").format(", round(1 / (1 + d), 5) as score"),
    "knn_filtered_type": _knn("e.label % 2 = 0").format(""),
    "token_overlap_router": f"with {_route()} select id, intent, score from rt",
    "token_overlap_router_whole": f"with {_route()} select intent, count(*) threads from rt group by 1",
    "seed_fusion_full_outer": sql(f"{_RANK}, sm as (select id, least(0.9, 0.3 + 0.1 * (len(string_split(lower(docstring), '{NAME}')) - 1)) sem from cn where contains(lower(docstring), '{NAME}')) select id, round(coalesce(sem, 0) + case when n.id2 is not null then 0.5 else 0.0 end, 6)::double score from (select coalesce(sm.id, nm.id) as id, sem, nm.id as id2 from sm full join nm on sm.id = nm.id) n order by score desc, id limit 50"),
    "snippet_normalise": r"select snippet, count(*) n from (select case when length(f) > 80 then substr(f, 1, 80) || '...' else f end as snippet from (select trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) f from documents where text is not null)) where length(snippet) > 0 group by 1 having count(*) > 1",
    "mermaid_safe_ids": sql(r"select safe2 as safe, count(*) n from (select case when length(s) > 30 then substr(s, 1, 20) || '_' || substr(md5(s), 1, 6) else s end as safe2 from (select regexp_replace(name, '[^\p{L}\p{N}]', '_', 'g') s from cn)) group by 1"),
    "context_for_query": sql(f"select id, cost, running from (select *, cast(sum(cost) over (order by node_seq rows between unbounded preceding and current row) as bigint) running from (select id, node_seq, cast(floor(length(concat_ws(': ', name, docstring)) / 4) as bigint) as cost from cn where contains(lower(name), '{NAME}') or contains(lower(docstring), '{NAME}') order by node_seq limit 10)) where running <= 512"),
    "dedupe_first_strategy": sql("select name, id, node_type from (select *, row_number() over (partition by name order by case node_type when 'class' then 1 when 'function' then 2 else 3 end, node_seq) rn2 from cn where node_type in ('class', 'function', 'method') and name is not null) where rn2 = 1"),
}
