"""python -m millrace QUERY SF_DIR [FOLDER]: runs a registered query, shows it or writes it as Parquet; without arguments, the names."""

from __future__ import annotations

import sys

from millrace.plans.queries import QUERIES


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in QUERIES:
        print("\n".join(sorted(QUERIES)))
        return int(bool(args))
    from pyspark.sql import SparkSession

    from millrace.session import prepared

    df = QUERIES[args[0]](prepared(SparkSession.builder.appName(f"millrace {args[0]}").getOrCreate()), args[1])
    df.write.parquet(args[2]) if len(args) > 2 else df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
