"""Query catalogue on the given tables."""

from importlib import import_module

MODULES = (
    "files", "integrity", "text", "joins", "aggregates", "windows", "plan_tables", "scoring",
    "events", "quality", "annotations",
)


def load() -> tuple[dict, dict]:
    from draftlake.catalogue.registry import ORACLES, QUERIES

    for m in MODULES:
        import_module(f"draftlake.catalogue.{m}")
    return QUERIES, ORACLES
