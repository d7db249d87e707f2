"""The life cycle of a batch extraction: submit, status, results and retry, with a client that the caller brings.

What was asked and what came back lies in a folder as Parquet, so each step can be run again, by
another driver too, and picks up where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import batch_cost
from ..operators.relational import last_wins, numbered
from .remote import parse_extractions, retried

REQUEST = "pmid string, prompt string, input_tokens long"
SUBMITTED = "pmid string, batch_id string, round int"
RESULT = "pmid string, status string, answer string, round int"


class Client(Protocol):
    """A batch service; it is sent to the tasks."""

    def submit(self, requests: list[tuple[str, str]]) -> str: ...

    def status(self, batch_id: str) -> dict[str, int]: ...

    def results(self, batch_id: str) -> list[tuple[str, str, str | None]]: ...


def estimated_cost(requests: DataFrame, output_tokens: int, per_million_in: float, per_million_out: float, discount: float = 0.5) -> float:
    """What requests (pmid, prompt, input_tokens) cost if each answer has ``output_tokens``."""
    total = requests.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("i"), (F.count(F.lit(1)) * output_tokens).alias("o"))
    return total.select(batch_cost(F.col("i"), F.col("o"), per_million_in, per_million_out, discount)).first()[0]


class Extraction:
    """One extraction of a corpus in rounds of batches, kept in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, client: Client, batch_size: int = 10_000):
        self.spark, self.folder, self.client, self.batch_size = spark, folder.rstrip("/"), client, batch_size

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return self.spark.createDataFrame([], schema)

    @property
    def submitted(self) -> DataFrame:
        return self._read("submitted", SUBMITTED)

    @property
    def results(self) -> DataFrame:
        """The last result of each request."""
        return last_wins(self._read("results", RESULT), ["pmid"], ["round"])

    def submit(self, requests: DataFrame, cost_cap: float | None = None, output_tokens: int = 1000, per_million_in: float = 3.0, per_million_out: float = 15.0) -> int:
        """Submits the requests that haven't been, in batches of ``batch_size``; returns how many.

        ValueError, and nothing is submitted, if their estimated cost is above ``cost_cap``.
        """
        new = requests.join(self.submitted.select("pmid").distinct(), "pmid", "left_anti")
        if cost_cap is not None and (cost := estimated_cost(new, output_tokens, per_million_in, per_million_out)) > cost_cap:
            raise ValueError(f"estimated cost {cost:.2f} is above the cap of {cost_cap:.2f}")
        return self._send(new, 1)

    def _send(self, requests: DataFrame, number: int) -> int:
        client, size = self.client, self.batch_size
        dealt = numbered(requests.select("pmid", "prompt"), "_n", ["pmid"]).withColumn("_batch", F.floor((F.col("_n") - 1) / size)).select("_batch", "pmid", "prompt")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []

            def done() -> pa.RecordBatch:
                batch_id = retried(lambda: client.submit(held))
                return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.string()), pa.array([batch_id] * len(held), pa.string()), pa.array([number] * len(held), pa.int32())], names=["pmid", "batch_id", "round"])

            for part in batches:
                for batch, pmid, prompt in zip(*(c.to_pylist() for c in part.columns)):
                    if batch != now and held:
                        yield done()
                        held = []
                    now = batch
                    held.append((pmid, prompt))
            if held:
                yield done()

        before = self.submitted.count()
        dealt.repartition("_batch").sortWithinPartitions("_batch", "pmid").mapInArrow(run, SUBMITTED).write.mode("append").parquet(f"{self.folder}/submitted")
        return self.submitted.count() - before

    def status(self) -> DataFrame:
        """(batch_id, status, n) as the service counts them; a row per batch and status, asked on the driver batch by batch."""
        ids = [r["batch_id"] for r in self.submitted.select("batch_id").distinct().orderBy("batch_id").collect()]
        rows = [(i, s, n) for i in ids for s, n in sorted(retried(lambda i=i: self.client.status(i)).items())]
        return self.spark.createDataFrame(rows, "batch_id string, status string, n long")

    def process(self) -> int:
        """Fetches the results of batches that have ended and aren't fetched yet; returns how many requests they answer."""
        client = self.client
        done = self._read("results", RESULT).select("pmid", "round").distinct()
        open_ = self.submitted.join(done, ["pmid", "round"], "left_anti").select("batch_id", "round").distinct()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for batch_id, number in zip(*(c.to_pylist() for c in part.columns)):
                    if retried(lambda: client.status(batch_id)).get("processing", 0):
                        continue
                    found = retried(lambda: client.results(batch_id))
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in found], pa.string()) for i in range(3)), pa.array([number] * len(found), pa.int32())], names=["pmid", "status", "answer", "round"])

        before = self._read("results", RESULT).count()
        open_.repartition("batch_id").mapInArrow(run, RESULT).write.mode("append").parquet(f"{self.folder}/results")
        return self._read("results", RESULT).count() - before

    def retry(self, requests: DataFrame) -> int:
        """Submits again, as the next round, the requests whose last result isn't a success; returns how many."""
        last = self.submitted.groupBy("pmid").agg(F.max("round").alias("round"))
        failed = self.results.where("status <> 'succeeded'").join(last, ["pmid", "round"]).select("pmid")
        number = (last.agg(F.max("round")).first()[0] or 0) + 1
        return self._send(requests.join(failed, "pmid", "left_semi"), number)

    def rows(self, pairs: DataFrame) -> DataFrame:
        """The triples of all last results, as ``parse_extractions`` gives them."""
        return parse_extractions(self.results.select("pmid", "status", "answer"), pairs)


def batch_sizes(submitted: DataFrame) -> DataFrame:
    """(batch_id, n, first, last): what lies in each batch."""
    return submitted.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("pmid").alias("first"), F.max("pmid").alias("last"))
