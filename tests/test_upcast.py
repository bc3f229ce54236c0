import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.upcast import MALFORMED, MISSING, UNSUPPORTED, Versions, compatibility


def fields(ddl):
    return T.StructType.fromDDL(ddl)


def schemas():
    return (fields("orderId string not null, status string"), fields("orderId string not null, status string, paymentMethod string"),
            fields("orderId bigint not null, state string not null, method string, amount decimal(19,2)"))


def versions():
    V1, V2, V3 = schemas()
    return (Versions().add("1", V1, aliases=("1.0",))
            .add("2", V2, lambda f: {**f, "status": F.when(f["status"] == "paid", "completed").otherwise(f["status"])}, aliases=("2.0",), defaults={"paymentMethod": "unknown"})
            .add("3", V3, lambda f: {"orderId": F.regexp_replace(f["orderId"], "^o", "").try_cast("bigint"), "state": F.upper(f["status"]), "method": f["paymentMethod"]},
                 defaults={"amount": 0}))


def test_mixed_versions_decode_to_the_newest(spark):
    rows = [(1, "1", '{"orderId":"o1","status":"paid","extra":{"x":1}}'), (2, "2.0", '{"orderId":"o2","status":"completed","paymentMethod":"card"}'),
            (3, "3", '{"orderId":3,"state":"NEW","method":"cash","amount":1.5}'), (4, None, '{"orderId":"o4","status":"open"}'),
            (5, "2", '{"orderId":"o5","status":"paid"}'), (6, "4", '{"orderId":"o6"}'), (7, "1", "{{"), (8, "1.0", None), (9, "1", '{"status":"paid"}'),
            (10, "1", '{"orderId":"x","status":"paid"}'), (11, "3", '{"orderId":11,"state":"NEW"}'), (12, "2", " "), (13, "1", '{"orderId":"o13"}')]
    got = {r.id: (r.decode_error, r.event and tuple(r.event)) for r in versions().decode(spark.createDataFrame(rows, "id int, version string, payload string")).collect()}
    zero = decimal.Decimal("0.00")
    assert got[1] == (None, (1, "COMPLETED", "unknown", zero)) and got[2] == (None, (2, "COMPLETED", "card", zero))
    assert got[3] == (None, (3, "NEW", "cash", type(zero)("1.50"))) and got[4] == (None, (4, "OPEN", "unknown", zero))
    # the step from 1 to 2 does not touch rows that are version 2 already
    assert got[5] == (None, (5, "PAID", "unknown", zero)) and got[11] == (None, (11, "NEW", None, zero))
    assert [got[k][0] for k in (6, 7, 8, 9, 10, 12, 13)] == [UNSUPPORTED, MALFORMED, MALFORMED, MISSING, MISSING, MALFORMED, MISSING]
    assert all(got[k][1] is None for k in (6, 7, 8, 9, 10, 12, 13))


def test_one_projection_whatever_the_number_of_versions(spark):
    df = spark.createDataFrame([(1, "1", "{}")], "id int, version string, payload string")
    plan = versions().decode(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and "PythonUDF" not in plan


def test_compatibility(spark):
    old = fields("a int, b string, c struct<x: float, y: array<int>>, d decimal(10,2), e map<string, int>")
    assert compatibility(old, fields("b string, a bigint, c struct<x: double, y: array<bigint>, z: string>, d decimal(12,2), e map<string, bigint>, f string")) == []
    broken = fields("a smallint, c struct<x: string, y: array<string>>, d decimal(10,4), e map<string, string>, g int not null")
    assert compatibility(old, broken) == ["a: int to smallint", "b: removed", "c.x: float to string", "c.y[]: int to string", "d: decimal(10,2) to decimal(10,4)",
                                          "e<value>: int to string", "g: new and required"]
    assert compatibility(fields("a int"), fields("a int not null")) == ["a: required, was optional"]
    assert compatibility(fields("a int"), fields("a int not null, b int not null"), {"a": 0, "b": 1}) == []


def test_steps_that_are_needed(spark):
    V1, V2, _ = schemas()
    with pytest.raises(ValueError, match="removed"):
        Versions().add("1", V1).add("2", fields("orderId string not null"))
    with pytest.raises(ValueError, match="known"):
        Versions().add("1", V1, aliases=("1.0",)).add("1.0", V2)
    assert Versions().add("1", V1).add("2", V2).latest == "2"
