"""Link candidates: what grows with the tables is never sent through the driver."""

import re

from strataloom.operators import link


def test_exploded_grams_are_not_broadcast(spark):
    a = spark.createDataFrame([("s1", "steel ring"), ("s2", "x"), ("s3", "customer 17")], "canonical_id string, label string")
    b = spark.createDataFrame([("t1", "ring"), ("t2", "axle x"), ("t3", "large customer 17 order")], "canonical_id string, label string")
    out = link.lexical_pairs(a, b)
    got = {(r.source_id, r.target_id, r.containment) for r in out.collect()}
    assert {("s1", "t1", 1.0), ("s2", "t2", 1.0), ("s3", "t3", 1.0)} <= got
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # Two joins each way send texts of one or two characters; nothing else.
    assert len(re.findall("BroadcastHashJoin", plan)) == 4 and "NestedLoop" not in plan
