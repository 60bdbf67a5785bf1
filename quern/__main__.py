"""python -m quern QUERY FOLDER: run a query by name over a folder of tables (survey S33)."""

from __future__ import annotations

import argparse
import os
import sys


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    """Options, with defaults from the environment; a number that isn't one counts as -1, which is all cores."""
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("query", help="a query's name, or 'list'")
    parser.add_argument("folder", nargs="?", default=os.environ.get("BENCH_SF_DIR", "."))
    parser.add_argument("--cpus", default=os.environ.get("BENCH_CPUS", os.environ.get("SLURM_CPUS_PER_TASK", "-1")))
    parser.add_argument("--limit", type=int, default=20, help="rows to show")
    parser.add_argument("--out", help="write the rows as Parquet instead")
    parser.add_argument("--explain", action="store_true", help="show the plan instead")
    found = parser.parse_args(arguments)
    try:
        found.cpus = int(found.cpus)
    except ValueError:
        found.cpus = -1
    return found


def main(arguments: list[str] | None = None) -> int:
    from quern.plans import catalogue
    from quern.session import local_session

    asked = parsed(arguments)
    if asked.query == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if asked.query not in catalogue.QUERIES:
        print(f"no query {asked.query!r}; 'list' shows them", file=sys.stderr)
        return 2
    spark = local_session(asked.cpus if asked.cpus > 0 else None)
    rows = catalogue.QUERIES[asked.query](spark, asked.folder)
    if asked.explain:
        rows.explain("formatted")
    elif asked.out:
        rows.write.mode("overwrite").parquet(asked.out)
    else:
        rows.show(asked.limit, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
