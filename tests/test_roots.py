"""Few roots are sent to their nodes, however many these are."""

from juristream.operators import writes


def test_few_roots_are_sent_to_their_nodes(spark):
    nodes = spark.createDataFrame([("n1", "d::D1"), ("n2", "d::D2"), ("n3", "x")], "node string, lineage string")
    asked = spark.createDataFrame([("d",), ("d::D2",), ("x",)], "asked string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = writes.by_alias(nodes, ["lineage"], asked)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == [("d", "n1"), ("d", "n2"), ("d::D2", "n2"), ("x", "n3")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
