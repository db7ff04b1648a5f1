"""All queries of the engine by name, with their DuckDB forms."""

from __future__ import annotations

from loomgraph.plans import chain_queries, graph_queries, text_queries

MODULES = [graph_queries, text_queries, chain_queries]
QUERIES: dict = {k: f for m in MODULES for k, f in m.Q.items()}
ORACLE: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = "khop_paths"
