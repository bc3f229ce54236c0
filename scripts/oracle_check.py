"""Run every registered query in Spark and its SQL oracle in DuckDB; compare.

Usage: python scripts/oracle_check.py [SF_DIR] [name-substring ...]
Env: BATCH_ONLY=1 skips streaming queries; BARE_SESSION=1 uses a plain
session; SESSION_TZ sets the session time zone.

Comparison: same column names, same row count, and the same multiset of rows
after normalising values (decimals and floats rounded to 6 places, timestamps
as ISO text).  Prints one line per query and a summary.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ledgerline.plans.catalog import all_queries  # noqa: E402
from ledgerline.schemas import DRIVER_TABLES  # noqa: E402
from ledgerline.session import get_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in sys.argv[1:] if not a.startswith("/")]
    tz = os.environ.get("SESSION_TZ")
    if os.environ.get("BARE_SESSION"):
        # The driver's own session: none of this package's settings.
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]")
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    else:
        spark = get_session("local[8]", shuffle_partitions=8,
                            extra={"spark.sql.session.timeZone": tz} if tz else None)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs = all_queries()
    ok = bad = skipped = 0
    for name, q in sorted(qs.items()):
        if pats and not any(p in name for p in pats):
            continue
        if os.environ.get("BATCH_ONLY") and q.fn.__module__.endswith("q_streaming"):
            continue
        t0 = time.time()
        try:
            sdf = q.fn(spark, sf_dir)
            scols = sdf.columns
            srows = sdf.collect()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SPARK {name}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"NO-ORACLE {name}: rows={len(srows)} ({ts:.1f}s)")
            skipped += 1
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SQL {name}: {str(e)[:400]}")
            bad += 1
            continue
        msg = []
        if sorted(scols) != sorted(dcols):
            msg.append(f"cols spark={scols} sql={dcols}")
        if len(srows) != len(drows):
            msg.append(f"rows spark={len(srows)} sql={len(drows)}")
        if not msg:
            a, b = rows_key(scols, srows), rows_key(dcols, drows)
            if a != b:
                diff_a = list((a - b).items())[:3]
                diff_b = list((b - a).items())[:3]
                msg.append(f"values differ: spark-only={diff_a} sql-only={diff_b}")
        if msg:
            bad += 1
            print(f"MISMATCH {name}: " + " | ".join(msg))
        else:
            ok += 1
            print(f"OK {name}: rows={len(srows)} ({ts:.1f}s)")
    print(f"SUMMARY ok={ok} bad={bad} no_oracle={skipped}")
    spark.stop()


if __name__ == "__main__":
    main()
