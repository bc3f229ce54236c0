import pytest
from pyspark.sql import functions as F

from ledgerline.operators.handlers import NO_RESULT, HandlerRegistry, resolved_type

ROWS = [(1, "A", 5), (2, "B", 6), (3, "C", 7), (4, None, 8), (5, "A", None), (6, "A2", 1)]


def rows(spark):
    return spark.createDataFrame(ROWS, "id long, event_type string, n int")


def test_types_reach_their_handler_and_others_the_default_branch(spark):
    seen = {}

    def handler_a(df):
        seen["a"] = {r.id for r in df.collect()}
        return df.select("id", (F.col("n") > 4).alias("ok"))

    registry = HandlerRegistry().register("A", handler_a, "a").register("A2", handler_a, "a")

    @registry.handles("B")
    def handler_b(df):
        return df.select("id", F.lit(False).alias("ok"), F.lit("refused").alias("error"))

    got = {r.id: (r.route, r.ok, r.error) for r in registry.run(rows(spark)).collect()}
    assert seen["a"] == {1, 5, 6}
    assert got == {1: ("a", True, None), 2: ("B", False, "refused"), 3: ("default", True, None), 4: ("default", True, None),
                   5: ("a", False, None), 6: ("a", False, None)}


def test_a_dropped_row_is_reported(spark):
    registry = HandlerRegistry().register("A", lambda df: df.where("n = 5").withColumn("ok", F.lit(True)))
    got = {r.id: (r.ok, r.error) for r in registry.run(rows(spark)).where("route = 'A'").collect()}
    assert got == {1: (True, None), 5: (False, NO_RESULT)}


def test_one_pass_over_the_source(spark):
    """Each handler reads its own folder: the source is evaluated once."""
    hits = spark.sparkContext.accumulator(0)
    counted = rows(spark).rdd.map(lambda r: (hits.add(1), r)[1]).toDF("id long, event_type string, n int")
    registry = HandlerRegistry()
    for kind in "ABC":
        registry.register(kind, lambda df, k=kind: df.withColumn("ok", F.lit(k != "B")))
    out = registry.run(counted)
    assert out.count() == len(ROWS) and hits.value == len(ROWS)
    assert "_route" in registry.run(rows(spark))._jdf.queryExecution().toString()


def test_conflicts_and_type_resolution(spark):
    with pytest.raises(ValueError):
        HandlerRegistry().register("A", lambda d: d).register("A", lambda d: d)
    with pytest.raises(ValueError):
        HandlerRegistry().register("A", lambda d: d, "x").register("B", lambda d: d, "x")
    df = spark.sql("""SELECT * FROM VALUES (1, map('eventType', 'P'), '{"eventType":"Q"}'), (2, map(), '{"eventType":"Q"}'),
                      (3, NULL, '{"eventType":"Q"}'), (4, NULL, '{{broken'), (5, NULL, NULL) AS t(id, props, payload)""")
    got = {r.id: r.t for r in df.select("id", resolved_type(F.col("props"), F.col("payload")).alias("t")).collect()}
    assert got == {1: "P", 2: "Q", 3: "Q", 4: "Unknown", 5: "Unknown"}
