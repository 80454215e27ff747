"""Queries over the given tables. Each module has QUERIES (name -> callable) and SQL (name -> oracle statement)."""

MODULES = ("change_queries", "search_queries", "graph_queries", "diff_queries", "context_queries", "extract_queries", "assembly_queries", "app_queries")
