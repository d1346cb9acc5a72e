"""The tables of ``docloom.store``."""

from ..store import drop_written, materialize, release, shared_dir

__all__ = ["drop_written", "materialize", "release", "shared_dir"]
