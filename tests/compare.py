"""Side-by-side run of registered queries against their SQL in an in-process engine."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, [tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect()]


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    names = sorted(have)
    at = [have.index(n) for n in names]
    return names, [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]


def _sortable(row):
    return tuple((v is None, "" if v is None else str(type(v) is str), "" if v is None else
                  (f"{v:020.4f}" if isinstance(v, (int, float)) else str(v))) for v in row)


def differences(df, con, sql) -> list[str]:
    names, got = rows_of(df)
    sql_names, want = rows_of_sql(con, sql)
    if names != sql_names:
        return [f"columns {names} against {sql_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}", f"{got[:3]} / {want[:3]}"]
    if sorted(map(repr, got)) == sorted(map(repr, want)):
        return []
    got.sort(key=_sortable)
    want.sort(key=_sortable)
    out = [f"{g} against {w}" for g, w in zip(got, want) if repr(g) != repr(w)]
    kinds = [(type(a).__name__, type(b).__name__) for a, b in zip(got[0], want[0])]
    return [f"{len(out)} of {len(got)} rows differ", str(names), str(kinds), *out[:3]]


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from pingtrail.session import build_session

    folder = argv[0]
    wanted = argv[1:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), oracle_sql()
    bad = 0
    for name, build in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = build(spark, folder)
            if name in sql:
                diff = differences(df, con, sql[name])
                n = "" if diff else df.count()
            else:
                diff, n = [], f"{df.count()} (rows only)"
        except Exception as e:  # report and go on
            diff = [type(e).__name__ + " " + str(e)[:700]]
        bad += bool(diff)
        print(f"{'BAD ' if diff else 'ok  '} {name} {n if not diff else ''} {time.time()-began:.1f}s",
              flush=True)
        for line in diff:
            print("      ", line)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
