"""``python -m pairloom list`` names the queries; ``python -m pairloom run NAME TABLES OUT`` writes one's result (Parquet, or CSV where OUT ends in .csv).

The session is the one that spark-submit brings; without one a local session is made. Each query that ``--all`` runs is isolated: one
that fails is reported, the others go on.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from pairloom.plans import catalog
from pairloom.session import local_session
from pairloom.streaming.quotes import isolated


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pairloom", description=__doc__)
    do = parser.add_subparsers(dest="do", required=True)
    do.add_parser("list", help="names of all queries, with their first lines")
    run = do.add_parser("run", help="write the result of one query, or of all of them")
    run.add_argument("name", nargs="?", help="a query's name")
    run.add_argument("tables", help="folder of the Parquet tables")
    run.add_argument("out", help="where the result goes")
    run.add_argument("--all", action="store_true", help="all queries, each to a folder of its name below OUT")
    a = parser.parse_args(args)
    if a.do == "list":
        for name, f in sorted(catalog.QUERIES.items()):
            print(f"{name}: {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}")
        return 0
    names = sorted(catalog.QUERIES) if a.all else [a.name]
    if unknown := [n for n in names if n not in catalog.QUERIES]:
        parser.error(f"no query {unknown[0]}")
    spark = SparkSession.getActiveSession() or local_session()

    def write(name: str) -> None:
        target = f"{a.out}/{name}" if a.all else a.out
        w = catalog.QUERIES[name](spark, a.tables).write.mode("overwrite")
        w.option("header", True).csv(target) if target.endswith(".csv") else w.parquet(target)

    failed = isolated({n: (lambda n=n: write(n)) for n in names})
    for name, why in failed.items():
        print(f"{name}: {why}", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
