import datetime as dt

import pytest
from pyspark.sql import functions as F

from cladewise.operators import analysis, params
from cladewise.sources import readers, synthetic, writers
from cladewise.streaming import counters


def test_tree_file_with_mixed_white_space(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("child\tparent\tlength\r\nb a  1.5\r\n\r\nc\ta\t2\n d   b\t3 \n")
    rows = readers.edges(spark, str(tmp_path / "t.tsv")).orderBy("ord").collect()
    assert [(r.child, r.parent, r.length) for r in rows] == [("b", "a", 1.5), ("c", "a", 2.0), ("d", "b", 3.0)]
    (tmp_path / "two.tsv").write_text("a b\nx y\n")
    (tmp_path / "none.tsv").write_text("")
    for name in ("two.tsv", "none.tsv"):
        with pytest.raises(readers.BadTable):
            readers.edges(spark, str(tmp_path / name))


def test_links_and_counts(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("species molecules\na\tx\n")
    (tmp_path / "r.tsv").write_text("molecules species\nx\ta\n")
    (tmp_path / "c.tsv").write_text("leaf n\na 3\na 4\n")
    (tmp_path / "d.tsv").write_text("leaf n\na -3\n")
    trees = ["species", "molecules"]
    assert [tuple(r) for r in readers.links(spark, str(tmp_path / "l.tsv"), trees).collect()] == [("a", "x")]
    with pytest.raises(ValueError):
        readers.links(spark, str(tmp_path / "r.tsv"), trees)
    assert [r.n for r in readers.paper_counts(spark, str(tmp_path / "c.tsv")).orderBy("ord").collect()] == [3, 4]
    with pytest.raises(readers.BadTable):
        readers.paper_counts(spark, str(tmp_path / "d.tsv"))


def test_states_and_parameters(spark, tmp_path):
    (tmp_path / "y.tsv").write_text("position\tY_state\tspecies\tmolecules\tfraction_of_one\n0\t1\ta\tx\t0.5\n1\t0\ta\ty\t0\n")
    (tmp_path / "z.tsv").write_text("species\tmolecules\tposition\tZ_state\na\tx\t4\t1\na\ty\t5\t0\n")
    (tmp_path / "p.csv").write_text("name,value\nepsilon,0.5\ngamma_species,2\n")
    assert [tuple(r) for r in readers.y_state(spark, str(tmp_path / "y.tsv")).collect()] == [(0, 0.5)]
    assert [r.position for r in readers.z_state(spark, str(tmp_path / "z.tsv")).collect()] == [4]
    assert sorted(tuple(r) for r in readers.parameters(spark, str(tmp_path / "p.csv")).collect()) == [("epsilon", 0.5), ("gamma_species", 2.0)]
    got = readers.delimited(spark, str(tmp_path / "z.tsv"), {"species": "string", "position": "long"})
    assert sorted(tuple(r) for r in got.collect()) == [("a", 4), ("a", 5)]


def test_scenario_round_trip(spark, tmp_path):
    tree = synthetic.balanced(spark, "s", 7)
    leaves = tree.select(F.col("child").alias("id"))
    values = params.last_by_name([spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double"), spark.createDataFrame([("a", 3.0)], "name string, value double")])
    writers.write_scenario(str(tmp_path), {"species": tree}, {"species": synthetic.poisson_counts(leaves)}, values)
    back = readers.edges(spark, str(tmp_path / "species" / "*.csv")) if len(list((tmp_path / "species").glob("*.csv"))) == 1 else None
    rows = readers.delimited(spark, str(tmp_path / "species"), {"child": "string", "parent": "string", "length": "double"})
    assert sorted(map(tuple, rows.collect())) == sorted((r.child, r.parent, r.length) for r in tree.collect())
    assert back is None or back.count() == 6
    got = readers.delimited(spark, str(tmp_path / "parameters"), {"name": "string", "value": "double"}, ",")
    assert sorted(map(tuple, got.collect())) == [("a", 3.0), ("b", 2.0)]


def test_trace(spark, tmp_path):
    path = str(tmp_path / "trace")
    for k in (1, 2):
        writers.append_trace(spark.createDataFrame([(k, k * 5)], "iteration int, position long"), path)
    assert spark.read.parquet(path).count() == 2


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", m % 3 == 0, m % 2 == 0) for m in range(20)]
    spark.createDataFrame(rows, "at timestamp, clique string, old boolean, new boolean").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("at timestamp, clique string, old boolean, new boolean").option("maxFilesPerTrigger", 1).parquet(source)
    q = counters.link_counts(stream, "at", "1 hour", "10 minutes", "clique").writeStream.outputMode("complete").format("memory").queryName("links_").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.sql("select * from links_").collect()) == 20
    q = counters.ones_by_clique(stream, "clique").writeStream.outputMode("complete").format("memory").queryName("ones_").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {c: sum(int(n) - int(o) for _, k, o, n in rows if k == c) for c in "ab"}
    assert {r.clique: r.n_ones for r in spark.sql("select * from ones_").collect()} == want
    counters.each_batch(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b.groupBy("clique").count()).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 20


def test_reports_over_nothing(spark):
    none = spark.createDataFrame([], "position long, truth double, predicted double")
    assert analysis.agreement(none).first().n == 0 and analysis.calibration(none).count() == 0
    edges, states = spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([], "node string, clique string, state int")
    got = analysis.transition_density(edges, states).first()
    assert got.matched_pairs == 0 and got.density_overall is None and got.coverage is None
    pairs = spark.createDataFrame([(k, float(k % 2), 0.5) for k in range(100)], "position long, truth double, predicted double")
    assert analysis.subsample(pairs, 30, "position").distinct().count() == 30
