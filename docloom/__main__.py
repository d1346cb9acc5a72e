"""``python -m docloom build ROOT OUT`` writes an index; ``python -m docloom query SF_DIR TOOL [name=value ...]``."""

from __future__ import annotations

import sys

from .registry import PLUGINS, Tools
from .session import session, ship


def main(args: list[str]) -> int:
    if len(args) >= 3 and args[0] == "build":
        from .operators.documents import public_only
        from .operators.index import write_index
        from .sources.front_matter import read_documents, typed

        spark = ship(session())
        docs = read_documents(spark, args[1])
        docs.write.mode("overwrite").partitionBy("source", "year").parquet(f"{args[2]}/documents")
        good = docs.filter("error is null")
        write_index(public_only(typed(good)), f"{args[2]}/index", id_col="path", text_col="body", keep=("typ",))
        docs.filter("error is not null").select("path", "error").show(truncate=False)  # these are not in the index
        return 0
    if len(args) >= 3 and args[0] == "query":
        tools = Tools(ship(session()), args[1]).load(PLUGINS)
        tools.guarded(args[2], **dict(a.split("=", 1) for a in args[3:])).show(truncate=80)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
