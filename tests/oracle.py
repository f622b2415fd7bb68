"""Run registered queries next to their SQL twins and compare the results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clueweave.session import get_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return repr(value)
    return str(value)


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    columns = [[canonical(v) for v in frame[c].astype(object).where(frame[c].notna(), None)] for c in frame]
    return sorted(zip(*columns)) if columns else []


def difference(spark_frame, sql_frame) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    kinds = [
        (c, spark_frame[c].dtype, sql_frame[c].dtype)
        for c in spark_frame
        if len(spark_frame) and spark_frame[c].dtype.kind != sql_frame[c].dtype.kind
        # integers with nulls are floats in one frame and nullable integers in the other
        and not (spark_frame[c].hasnans and {spark_frame[c].dtype.kind, sql_frame[c].dtype.kind} == {"f", "i"})
    ]
    if kinds:
        return f"types {kinds}"
    mine, theirs = rows_of(spark_frame), rows_of(sql_frame)
    if mine != theirs:
        extra = sorted(set(mine) - set(theirs))[:3]
        missing = sorted(set(theirs) - set(mine))[:3]
        return f"rows {len(mine)} != {len(theirs)}, only spark {extra}, only sql {missing}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = get_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__clueweave__scan__partitions="8",
    )
    con = connect(folder)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            mine = fn(spark, folder).toPandas()
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - started
        if name not in oracles:
            print(f"rows {name}: {len(mine)} rows, {spent:.1f}s", flush=True)
            continue
        started = time.time()
        try:
            theirs = con.execute(oracles[name]).df()
        except Exception as error:
            bad += 1
            print(f"FAIL {name} (sql): {str(error)[:600]}", flush=True)
            continue
        problem = difference(mine, theirs)
        bad += problem is not None
        print(
            f"{'FAIL' if problem else 'ok  '} {name}: {len(mine)} rows, spark {spent:.1f}s, "
            f"sql {time.time() - started:.1f}s {problem or ''}",
            flush=True,
        )
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
