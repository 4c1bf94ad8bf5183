"""Long chains of parents and long cycles."""

from impactloom.operators import graph


def test_lineage_reaches_the_root_and_reports_long_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(24)]
    cycle = [(100 + i, 100 + (i + 1) % 20) for i in range(20)]
    nodes = spark.createDataFrame(chain + cycle, "id long, parent long")
    got = [tuple(r) for r in graph.lineage(nodes, nodes.where("id IN (23, 100, 0)").select("id")).collect()]
    assert sorted(x for x in got if x[0] == 23) == sorted((23, 23 - i, i, False) for i in range(24))
    assert sorted(x for x in got if x[0] == 100) == sorted([(100, 100 + i, i, False) for i in range(20)] + [(100, 100, 20, True)])
    assert [x for x in got if x[0] == 0] == [(0, 0, 0, False)]
    assert graph.lineage(nodes, nodes.where("id < 0").select("id")).collect() == []
