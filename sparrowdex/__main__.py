"""Statistics of a stored index: `python -m sparrowdex stats --driver parquet --path FOLDER [--detailed]`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.stats import stats
from .sources.store import open_store


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparrowdex")
    parser.add_argument("command", choices=["stats"])
    parser.add_argument("--driver", default=None, help="kind of the store")
    parser.add_argument("--path", default=None)
    parser.add_argument("--detailed", action="store_true", help="with the most used terms")
    own = parser.parse_args(arguments)
    index = open_store(SparkSession.builder.getOrCreate(), own.driver, own.path).read()
    for name, rows in stats(index, own.detailed).items():
        print(f"{name}:")
        for r in rows.collect():
            print("  " + ", ".join(f"{k} {v}" for k, v in r.asDict().items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
