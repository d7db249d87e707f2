"""Commands on a small graph of files; dry runs write nothing."""

import pytest

from provloom.cli import main
from provloom.config import Settings


@pytest.fixture
def files(tmp_path):
    nodes, edges = tmp_path / "nodes.tsv", tmp_path / "edges.tsv"
    nodes.write_text("id\tlabel\ttype\torigin\na\toat\tFood\tc\nb\tglucan\tBioactive\tc\nLLM:x\tLactobacillus casei\tFood\tLLM\n")
    edges.write_text("subject_id\tpredicate\tobject_id\tconfidence\tevidence_count\tsources\na\tCONTAINS\tb\t0.9\t2\ts|t\nLLM:x\tPRODUCES\tb\t0.5\t1\tLLM\n")
    return str(nodes), str(edges)


def test_commands(spark, files, tmp_path, capsys):
    n, e = files
    base = ["--nodes", n, "--edges", e]
    out = str(tmp_path / "out")
    main(["report", *base], spark)
    assert "PASS: orphan nodes: 0" in capsys.readouterr().out
    main(["fix-schema", *base, "--dry-run", "--out", out], spark)
    assert "action=keep\tn=2" in capsys.readouterr().out and not (tmp_path / "out").exists()
    main(["fix-schema", *base, "--apply", "--out", out], spark)
    assert {r.id: r.type for r in spark.read.parquet(out + "/nodes").collect()}["LLM:x"] == "Microbe"
    main(["correct", *base, "--out", str(tmp_path / "c")], spark)
    assert "bucket=high_confidence_microbe\tn=1" in capsys.readouterr().out
    main(["load", *base, "--yes", "--out", str(tmp_path / "l")], spark)
    assert "nodes, edges: 3 2" in capsys.readouterr().out
    main(["export", *base, "--out", str(tmp_path / "x")], spark)
    assert spark.read.csv(str(tmp_path / "x/triples"), sep="\t").count() == 2


def test_evaluate(spark, tmp_path, capsys):
    head = "annot_id\tpredicate\tsubject_name\tobject_name\n"
    (tmp_path / "g.tsv").write_text(head + "A1\tP\toat\tglucan\n")
    (tmp_path / "f.tsv").write_text(head + "A1\tP\toats\tglucan\n")
    main(["evaluate", "--gold", str(tmp_path / "g.tsv"), "--found", str(tmp_path / "f.tsv")], spark)
    assert "tp=1\tfp=0\tfn=0" in capsys.readouterr().out


def test_settings(monkeypatch):
    monkeypatch.delenv("PROVLOOM_GRAPH", raising=False)
    assert Settings().missing() == ["PROVLOOM_GRAPH"]
    with pytest.raises(ValueError, match="PROVLOOM_GRAPH"):
        Settings().check()
