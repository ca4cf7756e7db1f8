"""Run registered queries and their SQL twins side by side: python tests/check.py [sf_dir] [name-part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.5f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> str:
    df = queries[name](spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return f"rows only ({len(mine)})"
    cursor = con.execute(oracles[name])
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    kinds = {d[0]: str(d[1]).upper() for d in cursor.description}
    known = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [f"{f.name}:{f.dataType.simpleString()}/{kinds[f.name]}" for f in df.schema.fields
           if known.get(f.dataType.simpleString()) != kinds[f.name]]
    a, b = rows_of(df.columns, mine), rows_of(columns, theirs)
    if a != b:
        left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"VALUES {len(a)} vs {len(b)}: spark {left} sql {right}"
    if not a:
        return "EMPTY"
    return f"ok {len(a)} rows" + (f"  TYPES {odd}" if odd else "")


def main() -> int:
    from filmloom.bindings import ORACLES, QUERIES
    from filmloom.session import build_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in QUERIES:
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir, QUERIES, ORACLES)
        except Exception as e:  # report and go on
            result = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        good = result.startswith(("ok", "rows only"))
        bad += not good
        print(f"{'  ' if good else '!!'} {name:32s} {time.time() - start:6.2f}s {result}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
