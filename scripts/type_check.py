"""Compare Spark and DuckDB column types for every registered query with an oracle.

Usage: python scripts/type_check.py [SF_DIR] [name-substring ...]
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import types as T
from ledgerline.session import get_session
from ledgerline.plans.catalog import all_queries
from ledgerline.schemas import DRIVER_TABLES

SF = sys.argv[1] if len(sys.argv) > 1 else '/root/testdata/sf0.001'
pats = sys.argv[2:]
MAP = {T.IntegerType: 'INTEGER', T.LongType: 'BIGINT', T.DoubleType: 'DOUBLE', T.StringType: 'VARCHAR',
       T.BooleanType: 'BOOLEAN', T.TimestampNTZType: 'TIMESTAMP', T.DateType: 'DATE', T.TimestampType: 'TIMESTAMP WITH TIME ZONE'}
def st(dt):
    for k, v in MAP.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.DecimalType):
        return f'DECIMAL({dt.precision},{dt.scale})'
    if isinstance(dt, T.ArrayType):
        return st(dt.elementType) + '[]'
    return dt.simpleString()
s = get_session('local[8]', shuffle_partitions=8)
con = duckdb.connect()
for t in DRIVER_TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
for n, q in sorted(all_queries().items()):
    if not q.sql or (pats and not any(p in n for p in pats)):
        continue
    if q.fn.__module__.endswith('q_streaming') and not pats:
        continue
    sch = {f.name: st(f.dataType) for f in q.fn(s, SF).schema.fields}
    rel = con.sql(q.sql)
    dd = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    diff = {c: (sch.get(c), dd.get(c)) for c in set(sch) | set(dd) if sch.get(c) != dd.get(c)}
    if diff:
        print('TYPE', n, diff)
print('done')
