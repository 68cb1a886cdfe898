import pytest

from cladewise.plans import cli
from cladewise.sources import readers


def test_scenario_simulate_infer_compare(spark, tmp_path):
    out = str(tmp_path / "s")
    made = ["--species-type", "balanced", "--species-nodes", "7", "--molecules-type", "star", "--molecules-nodes", "5", "--species-alpha", "0.4", "--molecules-bin", "3"]
    assert cli.main(["scenario", *made, "--out", out, "--seed", "3"], spark) == 0
    values = {r.name: r.value for r in readers.parameters(spark, f"{out}/parameters").collect()}
    assert {v for k, v in values.items() if k.startswith("species_alpha_")} == {0.4} and {v for k, v in values.items() if k.startswith("molecules_branch_lengths_")} == {3.0}
    assert (tmp_path / "s" / "simulate.sh").read_text().startswith("#!/bin/sh") and "--fix-branches" in (tmp_path / "s" / "infer.sh").read_text()
    both = ["--tree-species", f"{out}/species", "--tree-molecules", f"{out}/molecules", "--papers-species", f"{out}/species_papers", "--papers-molecules", f"{out}/molecules_papers"]
    assert cli.main(["simulate", *both, "--parameters", f"{out}/parameters", "--iterations", "0", "--out", f"{out}/simulated"], spark) == 0
    used = {r.name: r.value for r in readers.parameters(spark, f"{out}/simulated/parameters").collect()}
    assert {k: v for k, v in values.items() if "mean_log_nu" not in k and "var_log_nu" not in k} == pytest.approx(used)
    (tmp_path / "l.tsv").write_text("species molecules\nspecies_3 molecules_1\nspecies_4 molecules_2\n")
    assert cli.main(["infer", *both, "--links", str(tmp_path / "l.tsv"), "--iterations", "1", "--n-burnin", "0", "--fix-branches", "--out", f"{out}/inferred"], spark) == 0
    assert cli.main(["compare", "--parameters", f"{out}/parameters", "--summary", f"{out}/inferred/summary", "--out", f"{out}/compared"], spark) == 0
    names = {r.name for r in readers.delimited(spark, f"{out}/compared", {"name": "string"}, ",").collect()}
    assert names == set(values)
    assert cli.main(["infer", *both, "--links", f"{out}/species", "--out", f"{out}/bad"], spark) == 2


def test_assign(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("feature_id compound probability\nb y 0.4\na x 0.9\na y 0.2\n")
    assert cli.main(["assign", "--edges", str(tmp_path / "e.tsv"), "--min-score", "0.5", "--out", str(tmp_path / "o")], spark) == 0
    rows = readers.delimited(spark, str(tmp_path / "o" / "assignments"), {"Feature": "string", "Assigned_Molecule": "string", "Low_Confidence": "boolean"}, ",").collect()
    assert [tuple(r) for r in rows] == [("a", "x", False), ("b", "y", True)]


def test_wrong_options(spark):
    with pytest.raises(SystemExit):
        cli.main(["scenario", "--species-type", "ring"], spark)
    assert cli.main(["scenario", "--species-type", "grass", "--species-nodes", "3", "--molecules-type", "star", "--molecules-nodes", "5"], spark) == 2
