"""Every query of the library by name, and the SQL that gives the same rows."""

from corvid.plans import directive_queries, flow_queries, grammar_queries, graph_queries, interval_queries, lookup_queries, rule_queries, script_queries, shell_queries, text_queries, version_queries, workflow_queries, workspace_queries  # noqa: F401
from corvid.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
