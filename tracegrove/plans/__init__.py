"""The registered queries and their SQL."""

from . import chat_queries, doc_queries, graph_queries, orphan_queries, score_queries, search_queries, source_queries

_ALL = (orphan_queries, graph_queries, search_queries, chat_queries, score_queries, doc_queries, source_queries)
CORE_QUERIES = {name: f for m in _ALL for name, f in m.QUERIES.items()}
CORE_ORACLES = {name: text for m in _ALL for name, text in m.ORACLES.items()}
