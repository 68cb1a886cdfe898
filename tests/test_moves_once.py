"""The moves of all runs are made once, however many sums read them."""

from compare import DATA

from cladewise.plans import registry


def test_sums_over_moves_read_what_was_written(spark):
    got = registry.queries()["sv_g22_g30_moves"](spark, DATA)
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().asDict().items() >= {"twice": 0, "not_candidates": 0}.items()
