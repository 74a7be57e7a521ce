"""Registered queries over the data folder."""

from importlib import import_module

MODULES = ("tag_queries", "text_queries", "source_queries", "entity_queries", "search_queries", "vector_queries", "region_queries", "pipeline_queries")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tagloom.plans.{name}")
