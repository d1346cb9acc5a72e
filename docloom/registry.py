"""Named tools over the tables: plugins, argument checks, caps, telemetry and gap reports.

A plugin is a module with ``register(tools)``.  Plugins that are not installed are passed over; telemetry is laid
over all tools after the last plugin is registered.
"""

from __future__ import annotations

import functools
import importlib
import importlib.util
import inspect
import json
import os
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: Rows that a tool returns at most unless asked otherwise.
CAP = 200
Tool = Callable[..., DataFrame]


class Tools:
    """Callables ``(spark, sf_dir, **arguments) -> DataFrame`` by name."""

    def __init__(self, spark: SparkSession, sf_dir: str, log_dir: str | None = None) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.log_dir = log_dir or os.environ.get("DOCLOOM_LOG_DIR")
        self.tools: dict[str, Tool] = {}
        self.missing: list[str] = []

    def add(self, name: str, tool: Tool) -> None:
        if name in self.tools:
            raise ValueError(f"two tools are named {name}")
        self.tools[name] = tool

    def load(self, modules: Iterable[str]) -> Tools:
        """Register each module that is installed, then lay telemetry over all tools."""
        for m in modules:
            parent = m.rpartition(".")[0]
            if (parent and importlib.util.find_spec(parent) is None) or importlib.util.find_spec(m) is None:
                self.missing.append(m)
                continue
            importlib.import_module(m).register(self)
        self.tools = {name: self._counted(name, tool) for name, tool in self.tools.items()}
        return self

    def call(self, name: str, cap: int = CAP, **arguments) -> DataFrame:
        """A tool's first ``cap`` rows; unknown tools and arguments are errors that name the choices.

        Tools that rank keep their order; the rows of others are put in order of their columns before the cap.
        """
        if name not in self.tools:
            raise KeyError(f"no tool {name!r}; there are {', '.join(sorted(self.tools))}")
        tool = self.tools[name]
        known = list(inspect.signature(tool).parameters)[2:]
        if extra := set(arguments) - set(known):
            raise TypeError(f"{name} takes {', '.join(known) or 'no arguments'}, not {', '.join(sorted(extra))}")
        cleaned = {k: (v.strip() or None) if isinstance(v, str) else v for k, v in arguments.items()}
        rows = tool(self.spark, self.sf_dir, **cleaned)
        if getattr(tool, "ranks", False):
            return rows.limit(cap)
        sortable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
        return rows.orderBy(*[F.col(f"`{c}`") for c in sortable]).limit(cap)

    def guarded(self, name: str, cap: int = CAP, **arguments) -> DataFrame:
        """``call``, run to its end, with an error at any step as a row (error) instead of an exception.

        The rows come to the driver, which is to serve them: ``cap`` at most.
        """
        try:
            rows = self.call(name, cap, **arguments)
            return self.spark.createDataFrame(rows.collect(), rows.schema)
        except Exception as e:
            return self.spark.createDataFrame([(f"{type(e).__name__}: {e}",)], "error string")

    def _counted(self, name: str, tool: Tool) -> Tool:
        @functools.wraps(tool)
        def run(*args, **kwargs) -> DataFrame:
            began, error = time.time(), None
            try:
                return tool(*args, **kwargs)
            except Exception as e:
                error = type(e).__name__
                raise
            finally:
                self._append("telemetry", {"tool": name, "seconds": round(time.time() - began, 3), "error": error})

        return run

    def report_gap(self, question: str, detail: str = "") -> None:
        """Note a question that the documents do not answer; nothing leaves for the network."""
        self._append("gaps", {"question": question, "detail": detail})

    def _append(self, log: str, record: dict) -> None:
        if self.log_dir:  # on the driver, as it serves the tools
            os.makedirs(self.log_dir, exist_ok=True)
            with open(os.path.join(self.log_dir, f"{log}.jsonl"), "a", encoding="utf-8") as f:
                f.write(json.dumps(record, ensure_ascii=False) + "\n")


def ranks(tool: Tool) -> Tool:
    """Marks a tool whose rows come in an order of their own."""
    tool.ranks = True
    return tool


#: The plugins of this package.
PLUGINS = ("docloom.plans.tools",)
