"""Global ordering helpers that stay distributed.

``global_rank`` numbers rows 1..n in a total order without a single-task
window: a range-partitioned sort, then per-partition offsets computed on a
table with one row per partition (bounded by the partition count, so it is
broadcast).  ``monotonically_increasing_id`` after the sort carries the
partition index in its upper bits and the position inside the sorted
partition in its lower 33 bits.

The numbered rows are pinned once with a reliable, eager ``checkpoint`` (a job
runs while the plan is built; into the
shared ``spark.checkpoint.dir``) before anything else reads them.  Two plan
branches that each re-evaluate a range shuffle do not agree: the range
boundaries are sampled with a seed that depends on the RDD id, and AQE may
coalesce each reader differently, so per-partition counts taken from one
evaluation would not match the positions taken from another.  The pinned
rows carry their partition id and position as data, and a lost executor
re-reads them instead of recomputing a different numbering.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW_BITS = 33


def _numbered(ordered: DataFrame) -> DataFrame:
    """Add ``_pid`` (partition index) and ``_pos`` (0-based position inside
    it) to an already sorted frame and pin the result (see module doc)."""
    mid = (ordered.withColumn("_mid", F.monotonically_increasing_id())
           .withColumn("_pid", F.shiftright("_mid", _LOW_BITS).cast("int"))
           .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _LOW_BITS))
           .drop("_mid"))
    ensure_checkpoint_dir(ordered.sparkSession)
    return mid.checkpoint(eager=True)


def global_rank(df: DataFrame, order_cols: list, name: str = "rn") -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order_cols`` order."""
    return global_rank_and_counts(df, order_cols, name)[0]


def global_rank_and_counts(df: DataFrame, order_cols: list, name: str = "rn"):
    """``global_rank`` plus the per-partition row counts (``_pid``, ``_n``);
    their sum is the row count, obtained without another pass over ``df``.

    One range-partitioning shuffle and sort; the numbered rows are pinned and
    read twice (row counts per partition, then the numbering).  The offsets
    table has one row per partition.  ``order_cols`` must be a total order
    (end with a unique id) for the numbering to be a function of the data.
    """
    mid = _numbered(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols))
    per_part = mid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    ranked = (mid.join(F.broadcast(offsets), "_pid")
              .withColumn(name, F.col("_off") + F.col("_pos") + 1)
              .drop("_pid", "_pos", "_off"))
    return ranked, per_part


def with_neighbour(df: DataFrame, key_cols: list, order_cols: list, value_cols: list,
                   offset: int = 1, prefix: str = "prev_") -> DataFrame:
    """``lag`` (offset 1) or ``lead`` (offset -1) of ``value_cols`` within
    ``key_cols`` in ``order_cols`` order, without a window partitioned by key.

    Rows are range-sorted by (key, order) and pinned with their partition id
    and position.  The neighbour of a row is the previous (next) row of its
    own range partition — a window over one range partition, bounded by the
    partition size however large a key is — or, at the partition's first
    (last) row, the last (first) row of the previous (next) partition, taken
    from a table with one row per partition.  It counts only when its key is
    the row's key.
    """
    if offset not in (1, -1):
        raise ValueError("offset must be 1 (lag) or -1 (lead)")
    order = list(key_cols) + list(order_cols)
    mid = _numbered(df.repartitionByRange(*order).sortWithinPartitions(*order))
    nb = F.struct(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)],
                  *[F.col(c).alias(f"_v{i}") for i, c in enumerate(value_cols)])
    # A range shuffle on the partition id keeps each pinned partition in one
    # task (balanced), and satisfies the window's clustering without a hash.
    per_part = Window.partitionBy("_pid").orderBy("_pos")
    shift = F.lag if offset == 1 else F.lead
    local = mid.repartitionByRange("_pid").withColumn("_nb", shift(nb, 1).over(per_part))
    # Edge rows: each partition's last row (lag) or first row (lead, _pos 0);
    # only these P rows reach the aggregate and the window over partitions.
    if offset == 1:
        ends = mid.groupBy("_pid").agg(F.max("_pos").alias("_pos"))
        edge_rows = mid.join(F.broadcast(ends), ["_pid", "_pos"])
    else:
        edge_rows = mid.where(F.col("_pos") == 0)
    edges = (edge_rows.groupBy("_pid").agg(F.max_by(nb, "_pos").alias("_e"))
             .select("_pid", shift("_e", 1).over(Window.orderBy("_pid")).alias("_edge")))
    out = (local.join(F.broadcast(edges), "_pid")
           .withColumn("_nb", F.coalesce("_nb", "_edge")))
    same = None
    for i, k in enumerate(key_cols):
        cond = F.col(k).eqNullSafe(F.col(f"_nb._k{i}"))
        same = cond if same is None else same & cond
    out = out.withColumns({f"{prefix}{c}": F.when(same, F.col(f"_nb._v{i}"))
                           for i, c in enumerate(value_cols)})
    return out.drop("_pid", "_pos", "_nb", "_edge")


def _pinned(df: DataFrame, key_cols: list, order_cols: list) -> DataFrame:
    """Rows range-sorted by (key, order) and pinned with ``_pid`` and ``_pos``."""
    order = list(key_cols) + list(order_cols)
    return _numbered(df.repartitionByRange(*order).sortWithinPartitions(*order))


def _runs(mid: DataFrame, key_cols: list) -> DataFrame:
    """Pinned rows with ``_start``: the position in the partition at which the
    row's run of equal keys begins.  Null keys are equal to each other and form
    a run like any other key."""
    per_part = Window.partitionBy("_pid").orderBy("_pos")
    fresh = F.col("_pos") == 0
    for k in key_cols:
        fresh = fresh | ~F.col(k).eqNullSafe(F.lag(k).over(per_part))
    return (mid.repartitionByRange("_pid").withColumn("_fresh", fresh)
            .withColumn("_start", F.max(F.when(F.col("_fresh"), F.col("_pos")))
                        .over(per_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .drop("_fresh"))


def _carry(mid: DataFrame, key_cols: list, measures: list, over: list) -> DataFrame:
    """(``_pid``, ``_b0``, ``_b1``, ...): what each measure gives for the rows of
    earlier partitions that have the key of the partition's first run (combined
    by the measure's function in ``over``; null if there are none).

    Keys are sorted, so a partition adds to a later one only with the run of its
    own first key or of the next partition's first key.  Both come from a table
    with one row per partition, so the pinned rows are read as they are, without
    a window or an exchange, and at most two rows per partition are gathered."""
    def same(of):
        return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{of}._k{i}")) for i, k in enumerate(key_cols)])

    key = F.struct(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)])
    firsts = mid.where(F.col("_pos") == 0).groupBy("_pid").agg(F.max_by(key, "_pos").alias("_first"))
    tips = firsts.withColumn("_next", F.lead("_first").over(Window.orderBy("_pid")))
    side = F.when(same("_first"), 0).when(F.col("_next").isNotNull() & same("_next"), 1)
    edge = (mid.join(F.broadcast(tips), "_pid").withColumn("_side", side).where(F.col("_side").isNotNull())
            .groupBy("_pid", "_side").agg(*[m.alias(f"_m{i}") for i, m in enumerate(measures)])
            .join(F.broadcast(tips), "_pid")
            .withColumn("_key", F.when(F.col("_side") == 0, F.col("_first")).otherwise(F.col("_next"))))
    before = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_b{i}" for i in range(len(measures))]
    return (edge.withColumns({n: over[i](f"_m{i}").over(before) for i, n in enumerate(names)})
            .where(F.col("_side") == 0).select("_pid", *names))


def _carried(name: str) -> F.Column:
    """A carried value, in the partition's first run only."""
    return F.when(F.col("_start") == 0, F.col(name))


def rank_within(df: DataFrame, key_cols: list, order_cols: list, name: str = "pos") -> DataFrame:
    """1-based position inside each key in ``order_cols`` order (``row_number``;
    rows with a null key are numbered too).

    The position inside the row's run, plus, in a partition's first run, the
    rows that the key has in earlier partitions.  No exchange on the key."""
    mid = _pinned(df, key_cols, order_cols)
    carry = _carry(mid, key_cols, [F.count(F.lit(1))], [F.sum])
    return (_runs(mid, key_cols).join(F.broadcast(carry), "_pid")
            .withColumn(name, F.col("_pos") - F.col("_start") + 1 + F.coalesce(_carried("_b0"), F.lit(0)))
            .drop("_pid", "_pos", "_start", "_b0"))


def running_sum(df: DataFrame, key_cols: list, order_cols: list, value_col: str,
                name: str = "running") -> DataFrame:
    """Running sum of ``value_col`` within ``key_cols`` in ``order_cols`` order
    (a cumulative window, null keys included) as a distributed prefix sum:
    the sum inside the row's run plus the key's sum in earlier partitions.
    Null until the key's first value that is not null, as in a window."""
    mid = _pinned(df, key_cols, order_cols)
    carry = _carry(mid, key_cols, [F.sum(value_col)], [F.sum])
    within = (Window.partitionBy("_pid", "_start").orderBy("_pos")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here, earlier = F.col("_local"), _carried("_b0")
    return (_runs(mid, key_cols).withColumn("_local", F.sum(value_col).over(within))
            .join(F.broadcast(carry), "_pid")
            .withColumn(name, F.coalesce(here + earlier, here, earlier))
            .drop("_pos", "_pid", "_start", "_local", "_b0"))


def running_max(df: DataFrame, key_cols: list, order_cols: list, value_cols: list, prefix: str = "max_",
                least_cols: list = (), least_prefix: str = "min_", before: bool = False) -> DataFrame:
    """``{prefix}{value}``: the greatest value of the key's rows up to this one (nulls
    left out), as a prefix maximum: the maximum inside the row's run, and in a
    partition's first run that of the key's rows in earlier partitions too.

    ``{least_prefix}{value}``: the least, likewise.  ``before``: of the rows before
    this one only."""
    sides = [(f"{prefix}{c}", c, F.max, F.greatest) for c in value_cols] + [(f"{least_prefix}{c}", c, F.min, F.least) for c in least_cols]
    mid = _pinned(df, key_cols, order_cols)
    carry = _carry(mid, key_cols, [agg(c) for _, c, agg, _ in sides], [agg for _, _, agg, _ in sides])
    within = (Window.partitionBy("_pid", "_start").orderBy("_pos")
              .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow))
    out = _runs(mid, key_cols).withColumns({n: agg(c).over(within) for n, c, agg, _ in sides}).join(F.broadcast(carry), "_pid")
    return (out.withColumns({n: pick(n, _carried(f"_b{i}")) for i, (n, _, _, pick) in enumerate(sides)})
            .drop("_pid", "_pos", "_start", *[f"_b{i}" for i in range(len(sides))]))


def with_last(df: DataFrame, key_cols: list, order_cols: list, value_cols: list, size: int,
              name: str = "pos", prefix: str = "last_") -> DataFrame:
    """``name``: the position inside the key; ``{prefix}{value}``: the values of
    the key's last ``size`` rows up to this one, oldest first.

    A window of ``size`` rows inside each range partition, in the same pass as
    the run starts; the ``size - 1`` rows before a partition come from a table of
    so many rows per partition, read off the pinned rows."""
    values = F.struct(*[F.col(c).alias(c) for c in value_cols])
    mid = _pinned(df, key_cols, order_cols)
    edges = _carry(mid, key_cols, [F.count(F.lit(1))], [F.sum])
    rows = mid.withColumn("_v", values)
    if size > 1:
        sizes = mid.groupBy("_pid").agg(F.max("_pos").alias("_end"))
        tail = (rows.join(F.broadcast(sizes), "_pid").where(F.col("_pos") > F.col("_end") - (size - 1))
                .select("_pid", "_pos", "_v"))
        # One row per partition; each has a row at least, so size - 1 partitions back are enough.
        per = tail.groupBy("_pid").agg(F.sort_array(F.collect_list(F.struct("_pos", "_v"))).alias("_t"))
        back = Window.orderBy("_pid").rowsBetween(-(size - 1), -1)
        ends = (per.select("_pid", F.flatten(F.collect_list(F.col("_t._v")).over(back)).alias("_b"))
                .select("_pid", F.slice("_b", F.greatest(F.size("_b") - (size - 2), F.lit(1)), size - 1).alias("_before")))
        edges = edges.join(ends, "_pid")
    else:
        edges = edges.withColumn("_before", F.array().cast(f"array<{dict(rows.dtypes)['_v']}>"))
    within = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(-(size - 1), Window.currentRow)
    near = F.when(F.col("_pos") < size - 1, F.concat("_before", "_here")).otherwise(F.col("_here"))
    out = (_runs(rows, key_cols).withColumn("_here", F.collect_list("_v").over(within)).join(F.broadcast(edges), "_pid")
           .withColumn(name, F.col("_pos") - F.col("_start") + 1 + F.coalesce(_carried("_b0"), F.lit(0)))
           .withColumn("_all", near)
           .withColumn("_n", F.least(F.lit(size), F.col(name)).cast("int"))
           .withColumn("_own", F.slice("_all", F.size("_all") - F.col("_n") + 1, F.col("_n"))))
    return (out.withColumns({f"{prefix}{c}": F.col(f"_own.{c}") for c in value_cols})
            .drop("_pid", "_pos", "_start", "_b0", "_v", "_before", "_here", "_all", "_n", "_own"))


def exact_quantiles(df: DataFrame, col: str, probs: list, prefix: str = "p",
                    with_count: bool = False) -> DataFrame:
    """Exact continuous quantiles (linear interpolation between the ranks
    ``floor((n-1)p)`` and ``ceil((n-1)p)``, as SQL ``percentile_cont``).

    Rows are counted per value first (combined map-side), so only the different
    values are sorted and pinned; the value at a rank is the least one whose
    cumulative count reaches it.  Counts per range partition tell which
    partitions hold a wanted rank: only their rows get a cumulative count.
    Returns one row with a column ``{prefix}{int(p*100)}`` per probability.
    """
    counts = (df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
              .groupBy("_v").agg(F.count(F.lit(1)).alias("_c")))
    mid = _numbered(counts.repartitionByRange("_v").sortWithinPartitions("_v"))
    by_part = Window.orderBy("_pid")
    parts = (mid.groupBy("_pid").agg(F.sum("_c").alias("_s"))
             .select("_pid", F.sum("_s").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
                     F.sum("_s").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"), "_s"))
    spots = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = [r + 1 for h in spots for r in (F.floor(h), F.ceil(h))]
    off = F.col("_upto") - F.col("_s")
    wanted = reduce(or_, [(off < r) & (r <= F.col("_upto")) for r in ranks])
    within = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (mid.join(F.broadcast(parts.where(wanted)), "_pid").repartitionByRange("_pid")
            .withColumn("_cum", off + F.sum("_c").over(within)))

    def at(rank):
        return F.min(F.when(F.col("_cum") >= rank, F.col("_v")))

    picks = []
    for i, h in enumerate(spots):
        picks += [at(F.floor(h) + 1).alias(f"_lo{i}"), at(F.ceil(h) + 1).alias(f"_hi{i}"),
                  F.max(h - F.floor(h)).alias(f"_f{i}")]
    got = rows.agg(*picks, F.coalesce(F.max("_n"), F.lit(0)).alias("n"))
    out = [(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"{prefix}{int(round(p * 100))}")
           for i, p in enumerate(probs)]
    return got.select(*out, *(["n"] if with_count else []))
