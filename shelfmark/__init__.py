"""Bibliographic matching and acquisition analytics on Spark DataFrames."""

from __future__ import annotations

import importlib

#: What callers use, by the module that holds it; a name is imported when it is first asked for.
_API = {
    "scratch": "session", "Selection": "config", "load_config": "config", "search": "plans.matching", "read_works": "sources.works", "write_csv": "sources.works", "read_index": "sources.works",
    "backup": "sources.works", "json_records": "sources.records", "all_json_records": "sources.records", "sru_records": "sources.records", "all_sru_records": "sources.records", "hathi_records": "sources.records",
    "load_state": "sources.state", "save_state": "sources.state", "HttpSource": "sources.http", "with_scores": "operators.select", "select_best": "operators.select", "fallbacks": "operators.select", "search_result": "operators.select",
    "pending": "operators.ledger", "apply_status": "operators.ledger", "upsert": "operators.ledger", "add_deferred": "operators.queue", "quota_view": "operators.queue", "manifest_plan": "operators.downloads", "run_plan": "operators.downloads",
    "page_sources": "operators.iiif", "renderings": "operators.iiif", "manifest_metadata": "operators.iiif", "verify": "operators.verify", "preview": "operators.transfers", "run_batch": "operators.batch",
}
__all__ = sorted(_API)


def __getattr__(name: str):
    if name not in _API:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module = importlib.import_module(f"{__name__}.{_API[name]}")
    # a module of the same name would hide it
    return getattr(module, "run" if name == "run_batch" else name)


def __dir__() -> list[str]:
    return __all__
