"""Time-range joins without all-pairs fan-out (J11 batch twin).

An interval condition ``right.ts in [left.ts + lo, left.ts + hi]`` on a key
becomes an equi-join on (key, time bucket): the left side is replicated into
the few buckets its interval touches, the right side sits in one bucket, so
only rows close in time meet and a hot key is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import ts

_EPOCH = "1970-01-01 00:00:00"


def _secs(col):
    return F.timestamp_diff("SECOND", ts(_EPOCH), col)


def interval_left_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                       lo_seconds: int, hi_seconds: int, bucket_seconds: int | None = None,
                       left_id: str = "id", right_prefix: str = "r_") -> DataFrame:
    """Left outer join of ``left`` with every ``right`` row of the same key whose
    time lies in ``[left_ts + lo, left_ts + hi]`` (inclusive).  Unmatched left
    rows appear once with null right columns."""
    b = bucket_seconds or max(1, hi_seconds - lo_seconds)
    r = right.select(*[F.col(c).alias(right_prefix + c) for c in right.columns])
    r = r.withColumn("_b", F.floor(_secs(F.col(right_prefix + right_ts)) / b).cast("bigint"))
    lsec = _secs(F.col(left_ts))
    first = F.floor((lsec + lo_seconds) / b).cast("bigint")
    last = F.floor((lsec + hi_seconds) / b).cast("bigint")
    lx = left.withColumn("_b", F.explode(F.sequence(first, last)))
    cond = ((lx[key] == r[right_prefix + key]) & (lx["_b"] == r["_b"])
            & (r[right_prefix + right_ts] >= F.timestamp_add("SECOND", F.lit(lo_seconds), lx[left_ts]))
            & (r[right_prefix + right_ts] <= F.timestamp_add("SECOND", F.lit(hi_seconds), lx[left_ts])))
    matched = lx.join(r, cond, "inner").drop("_b")
    unmatched = left.join(matched.select(left_id).distinct(), left_id, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
