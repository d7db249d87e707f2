"""Batch extraction, paced and paged services, and the commands that use them."""

import json

import pytest

from provloom.cli import main
from provloom.schema import pair_schema
from provloom.sources import extraction, remote

FOLDER = {}


class Client:
    """Keeps batches as files; ids that end in 9 fail until a batch holds nothing else; "slow" is still processing."""

    def __init__(self, folder=None):
        self.folder = folder or FOLDER["path"]

    def submit(self, requests):
        import os

        os.makedirs(self.folder, exist_ok=True)
        name = f"b-{requests[0][0]}-{len(os.listdir(self.folder))}"
        with open(f"{self.folder}/{name}", "w") as f:
            json.dump([i for i, _ in requests], f)
        return name

    def _ids(self, batch):
        with open(f"{self.folder}/{batch}") as f:
            return json.load(f)

    def status(self, batch):
        return {"processing": 1} if "slow" in self._ids(batch) else {"succeeded": len(self._ids(batch))}

    def results(self, batch):
        ids = self._ids(batch)
        again = all(i.endswith("9") for i in ids)
        answer = json.dumps({"triples": [{"subject_name": "oat", "subject_type": "Food", "predicate": "CONTAINS", "object_name": "glucan", "object_type": "Bioactive", "evidence_span": "x", "evidence_type": "y", "confidence": 0.9, "notes": ""}]})
        return [(i, "errored", None) if i.endswith("9") and not again else (i, "succeeded", answer) for i in ids]


def test_extraction_life_cycle(spark, tmp_path):
    job = extraction.Extraction(spark, str(tmp_path / "job"), Client(str(tmp_path / "service")), batch_size=4)
    requests = spark.createDataFrame([(str(i), "p", 1000) for i in range(1, 11)], extraction.REQUEST)
    with pytest.raises(ValueError, match="above the cap"):
        job.submit(requests, cost_cap=0.01)
    assert job.submitted.count() == 0
    assert job.submit(requests, cost_cap=10.0) == 10 and job.submit(requests) == 0
    assert sorted(r.n for r in job.status().collect()) == [2, 4, 4]
    assert job.process() == 10 and job.process() == 0
    assert {r.pmid for r in job.results.where("status = 'errored'").collect()} == {"9"}
    assert job.retry(requests) == 1 and job.process() == 1 and job.retry(requests) == 0
    assert {r.triple_id for r in job.rows(pair_schema(spark)).collect()} == {"T1"} and job.results.count() == 10
    job.submit(spark.createDataFrame([("slow", "p", 1)], extraction.REQUEST))
    assert job.process() == 0
    assert extraction.estimated_cost(requests.limit(0), 100, 3.0, 15.0) == 0.0


def test_batch_commands(spark, tmp_path, capsys):
    FOLDER["path"] = str(tmp_path / "service")
    (tmp_path / "r.jsonl").write_text("".join(json.dumps({"pmid": str(i), "prompt": "p", "input_tokens": 10}) + "\n" for i in range(3)))
    base = ["--client", f"{__name__}:Client", "--folder", str(tmp_path / "job")]
    with pytest.raises(ValueError, match="cap"):
        main(["batch", "submit", *base, "--requests", str(tmp_path / "r.jsonl"), "--cost-cap", "0.0001"], spark)
    main(["batch", "submit", *base, "--requests", str(tmp_path / "r.jsonl"), "--cost-cap", "1"], spark)
    main(["batch", "status", *base], spark)
    main(["batch", "process", *base], spark)
    main(["batch", "rows", *base, "--out", str(tmp_path / "rows")], spark)
    out = capsys.readouterr().out
    assert "submitted: 3" in out and "status=succeeded\tn=3" in out and "results: 3" in out
    assert spark.read.csv(str(tmp_path / "rows"), sep="\t", header=True).count() == 3


def test_literature_command(spark, tmp_path, capsys):
    (tmp_path / "n.tsv").write_text("id\tlabel\ttype\torigin\na\toat\tFood\tc\nb\tglucan\tBioactive\tc\n")
    (tmp_path / "e.tsv").write_text("subject_id\tpredicate\tobject_id\tconfidence\tevidence_count\tsources\na\tCONTAINS\tb\t0.5\t2\ts\n")
    head = "annot_id\tpmid\ttriple_id\tsubject_name\tsubject_type\tpredicate\tobject_name\tobject_type\tconfidence\n"
    rows = ["A1\t1\tT1\toats\tFood\tCONTAINS\tglucan\tBioactive\t0.9", "A1\t1\tT2\trye\tFood\tCONTAINS\tglucan\tBioactive\t0.8", "A1\t1\tT3\toat\tFood\tCONTAINS\tdisease x\tIBD_Outcome\t0.8", "A2\t2\tT0\t-\t-\tNONE\t-\t-\t0"]
    (tmp_path / "r.tsv").write_text(head + "\n".join(rows) + "\n")
    base = ["load-literature", "--nodes", str(tmp_path / "n.tsv"), "--edges", str(tmp_path / "e.tsv"), "--rows", str(tmp_path / "r.tsv"), "--out", str(tmp_path / "g")]
    main([*base, "--dry-run"], spark)
    out = capsys.readouterr().out
    assert "rows=3\tvalid=2\tdropped=1" in out and "type=Food\tn=1" in out and not (tmp_path / "g").exists()
    main([*base, "--load"], spark)
    assert "nodes, edges: 3 2" in capsys.readouterr().out
    edges = {(r.subject_id, r.object_id): r.confidence for r in spark.read.parquet(str(tmp_path / "g/edges")).collect()}
    assert edges == {("a", "b"): 0.9, ("LLM:rye", "b"): 0.8}


def test_paced():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    ask = remote.Paced(lambda x: x, 2.0, lambda: now[0], sleep)
    assert [ask(i) for i in range(3)] == [0, 1, 2] and slept == [0.5, 0.5]
    now[0] += 5
    ask(3)
    assert slept == [0.5, 0.5]


def test_services_with_nothing_to_ask(spark):
    none = spark.createDataFrame([(None,), (" ",)], "name string")
    assert remote.look_up(none, "name", lambda n: None, lambda n: None).collect() == []
    assert remote.search_pages(spark, [], lambda q, a, p: []).collect() == []
    assert remote.read_service(spark, ["x"], lambda r: "", "a", "b").collect() == []
