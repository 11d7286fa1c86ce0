"""Registered queries, and the semantic layer."""

from quarry.plans import content_queries, corpus_queries, ordered_queries, relational_queries, report_queries, retrieval_queries, serving_queries, stored_queries, text_queries
from quarry.plans.registry import Registry

REGISTRY = Registry()
for _part in (relational_queries, text_queries, ordered_queries, retrieval_queries, content_queries, corpus_queries, serving_queries, report_queries, stored_queries):
    REGISTRY.update(_part.R)
