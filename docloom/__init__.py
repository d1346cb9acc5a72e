"""docloom: document-collection analytics on Spark DataFrames.

The names below are loaded when they are first used.
"""

from __future__ import annotations

import importlib

_PUBLIC = {
    "fold": "docloom.functions.text",
    "stem": "docloom.functions.czech",
    "slug": "docloom.functions.text",
    "query_terms": "docloom.operators.search",
    "search": "docloom.operators.search",
    "write_index": "docloom.operators.index",
    "append_index": "docloom.operators.index",
    "open_index": "docloom.operators.index",
    "read_documents": "docloom.sources.front_matter",
    "Tools": "docloom.registry",
    "session": "docloom.session",
    "ship": "docloom.session",
}

__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_PUBLIC[name]), name)
