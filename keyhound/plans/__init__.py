"""Whole scans and the catalogue of queries over the test tables."""

from importlib import import_module

_MODULES = ["catalog_sources", "catalog_extract", "catalog_trees", "catalog_match", "catalog_reports"]


def _load():
    for name in _MODULES:
        import_module(f"keyhound.plans.{name}")
    return import_module("keyhound.plans.catalog")


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict:
    return dict(_load().ORACLES)


def flagship(spark, folder: str):
    return all_queries()["scan_everything"](spark, folder)
