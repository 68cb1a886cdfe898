"""The tree of a step in all cliques is made once, however many sums read it, and a sweep moves only what it uses."""

import pytest
from compare import DATA

from cladewise.operators import field
from cladewise.plans import field_queries as fq
from cladewise.plans import registry


@pytest.mark.parametrize("name", ["sv_g07_g08_likeliest_z", "sv_g17_simulated_z"])
def test_steps_read_the_written_tree(spark, name):
    got = registry.queries()[name](spark, DATA)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == got.select("clique", "node_ix").distinct().count() > 0


def test_a_sweep_without_links_moves_none(spark):
    kinds = [{r.kind for r in field._grid_blocks(fq.field_tables(spark, DATA, links), fq.y_of(spark, DATA))[0].select("kind").distinct().collect()} for links in (False, True)]
    assert kinds == [{0, 1, 2, 5}, {0, 1, 2, 4, 5}]
