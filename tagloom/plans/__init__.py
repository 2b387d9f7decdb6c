"""Registered queries over the driver's tables, each with its SQL equivalent where there is one."""

from tagloom.plans import audit_queries, manifest_queries, relation_queries, text_queries
from tagloom.plans.views import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit_queries", "manifest_queries", "relation_queries", "text_queries"]
