"""An export finds the references of the few symbols that it tells of where they lie, before their paths are asked for."""

from symgrid.operators import summary
from tests.test_adjacency import plan
from tests.test_workspace import baseline  # noqa: F401


def test_references_do_not_move_to_the_few_symbols(spark, baseline):  # noqa: F811
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        said = plan(summary._detail_lines(baseline, "full"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    joins = [s for s in said.split("\n(") if "Left keys" in s and "[from_symbol_id" in s]
    assert len(joins) >= 2 and all("BroadcastHashJoin" in s for s in joins)
