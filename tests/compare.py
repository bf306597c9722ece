"""Run registered queries and their oracle SQL side by side.

    [NO_BROADCAST=1] python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return value if value is None else str(value)


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def difference(df, con, sql: str) -> str | None:
    """None when both results agree in columns, types and values."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for field in df.schema:
        mine = KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if mine != kinds[field.name]:
            return f"type of {field.name}: {mine} != {kinds[field.name]}"
    ours = [tuple(r) for r in df.collect()]
    a, b = _bag(df.columns, ours), _bag(names, theirs)
    if a == b:
        return None
    only_a, only_b = a - b, b - a
    return (f"rows {len(ours)} / {len(theirs)}, only ours {sum(only_a.values())} {list(only_a)[:2]}, "
            f"only oracle {sum(only_b.values())} {list(only_b)[:2]}")


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("NO_BROADCAST"):  # takes the paths meant for large tables
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {str(error)[:1500]}"
        if note.startswith(("DIFF", "ERROR")):
            bad.append(name)
        print(f"{name:32s} {time.time() - start:6.1f}s {note}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
