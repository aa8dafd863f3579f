"""python -m assize QUERY FOLDER [table|compact|json]: run a registered query and print its first rows."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import registry, render


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in registry.queries():
        print(__doc__, "\nQueries:", *sorted(registry.queries()), file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    whole = registry.queries()[argv[0]](spark, argv[1])
    df = whole.limit(render.MOST_ROWS)
    n = whole.count()
    if n > render.MOST_ROWS:
        print(f"The first {render.MOST_ROWS} of {n} rows:", file=sys.stderr)
    print({"table": render.table, "compact": render.compact, "json": render.as_json}[argv[2] if len(argv) > 2 else "table"](df))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
