"""``python -m symgraph tools | TOOL DIRECTORY [ARGUMENT...] | query DIRECTORY NAME | index CHECKOUT PROJECT TABLE | status TABLE``

``index`` walks a checkout and brings the table of its records up to date: a first run reads every
file, a later one those whose content changed, and files that are gone are removed.
"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from .engine import TOOLS, Engine

    if args[:1] == ["tools"]:
        print("\n".join(TOOLS))
        return 0
    least = {"query": 3, "index": 4, "status": 2}
    if len(args) < least.get(args[0] if args else "", 2) or args[0] not in (*TOOLS, *least):
        print(__doc__)
        return 2
    from .session import get_spark

    spark = get_spark()
    if args[0] == "index":
        from .sources.code import walk
        from .streaming.index import IncrementalIndex

        table = IncrementalIndex(spark, args[3])
        print(f"version {table.refresh(walk(spark, args[1], args[2]).select('project_id', 'file_path', 'content'))}")
        return 0
    if args[0] == "status" and len(args) == 2 and not args[1].startswith("--"):
        from .streaming.index import IncrementalIndex

        table = IncrementalIndex(spark, args[1])
        if table.generation:
            table.table.snapshot().groupBy("project_id", "language", "record", "kind").count().orderBy("project_id", "language", "record", "kind").show(200, False)
            return 0
    if args[0] == "query":
        from importlib import import_module

        for name in ("pipeline", "relational", "analysis", "lifecycle"):
            found = import_module(f"symgraph.plans.{name}").registry.queries.get(args[2])
            if found:
                found(spark, args[1]).show(50, False)
                return 0
        print(f"no query {args[2]!r}")
        return 2
    typed = [int(a) if a.isdigit() else a for a in args[2:]]
    getattr(Engine.of_directory(spark, args[1]), args[0])(*typed).show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
