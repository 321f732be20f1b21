"""Composed jobs and the catalogue of runnable queries."""

from importlib import import_module

GROUPS = ["urls", "pages", "contacts", "business", "match", "unify", "reports", "jsonld", "jobs", "tables", "whole"]


def load_all():
    for g in GROUPS:
        import_module(f"contactmill.plans.queries_{g}")
    from contactmill.plans.catalog import ENTRIES
    return ENTRIES
