"""Compare registered queries with their SQL on one folder of tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def _rows(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_cell(r[i]) for i in order]) for r in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None where both give the same columns and rows, else what differs."""
    got_names = spark_df.columns
    got = _rows(got_names, spark_df.collect())
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = _rows(want_names, cur.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3]
    lost = [r for r in want if r not in set(got)][:3]
    return f"rows {len(got)} != {len(want)}; only in Spark {extra}; only in SQL {lost}"


def main() -> None:
    import __spark_entry__ as entry

    from hireloom.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                result = difference(df, con, sqls[name]) or "ok"
            else:
                result = f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001
            result = "ERROR " + str(exc)[:900]
        print(f"@@ {name:32s} {time.time() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    main()
