"""All registered queries with the SQL that gives the same rows."""

import importlib

QUERIES: dict = {}
ORACLE: dict = {}
for _name in ("matching", "timelines", "transcripts", "calls", "composites"):
    _module = importlib.import_module(f"{__name__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
