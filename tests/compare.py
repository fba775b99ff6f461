"""python tests/compare.py SF_DIR [NAME...]: runs queries beside their SQL and compares all rows."""

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(cols, rows):
    def plain(v):
        if isinstance(v, bytearray):
            return bytes(v)
        if isinstance(v, Decimal):
            return v.normalize() + 0 if v else Decimal(0)
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return v

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    assert sorted(cols) == sorted(df.columns), (name, cols, df.columns)
    assert got == want, (name, len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    return len(got), True


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


if __name__ == "__main__":
    import __spark_entry__ as e
    from chainloom.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    q, o, con = e.queries(), e.oracle_sql(), duck(sys.argv[1])
    for n in [x for x in q if not names or any(x.startswith(p) for p in names)]:
        t = time.time()
        try:
            print(n, *compare(spark, con, n, q[n], o.get(n), sf_dir), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(n, "FAILED", str(x)[:1500], flush=True)
