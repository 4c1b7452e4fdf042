"""Timed training runs over a corpus: specifications, a report that must fit its schema, tables, and the history of reports."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import bpe, evaluate, hybrid, sequences, telemetry, unigram
from corpusloom.sources import store


@dataclass(frozen=True)
class Spec:
    """A run: what is trained and how much; reference names the run whose throughput times weight is expected."""

    name: str
    kind: str = "bpe"
    merges: int = 8
    vocab_size: int = 288
    epochs: int = 1
    cycles: int = 1
    longest: int = 8
    partitions: int | None = None
    reference: str | None = None
    weight: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in RUNNERS:
            raise ValueError(f"{self.name}: {self.kind} is none of {', '.join(RUNNERS)}")


def _bpe(seqs: DataFrame, s: Spec) -> dict:
    return {"merges": [list(m[1:4]) for m in bpe.train(seqs, s.merges)]}


def _unigram(seqs: DataFrame, s: Spec) -> dict:
    return {"vocab": len(unigram.fit(seqs, s.epochs, s.vocab_size, s.longest).pieces)}


def _hybrid(seqs: DataFrame, s: Spec) -> dict:
    model = hybrid.fit(seqs, s.cycles, s.merges, s.epochs, s.vocab_size, s.longest)
    return {"merges": [list(m[1:4]) for m in model.merges], "vocab": len(model.vocabulary.pieces)}


RUNNERS = {"bpe": _bpe, "unigram": _unigram, "hybrid": _hybrid}


def over_partitions(base: Spec, counts: list[int]) -> list[Spec]:
    """The same run over several numbers of partitions, each expected to scale from the first."""
    first = replace(base, name=f"{base.name}-{counts[0]}", partitions=counts[0])
    return [first, *(replace(base, name=f"{base.name}-{n}", partitions=n, reference=first.name, weight=n / counts[0]) for n in counts[1:])]


def default_specs(merges: int = 8, vocab_size: int = 288, partitions: list[int] | None = None) -> list[Spec]:
    bpe_runs = over_partitions(Spec("bpe", "bpe", merges), partitions) if partitions else [Spec("bpe", "bpe", merges)]
    return [*bpe_runs, Spec("unigram", "unigram", vocab_size=vocab_size), Spec("hybrid", "hybrid", merges, vocab_size)]


def run(seqs: DataFrame, specs: list[Spec], sources: list[str] = ()) -> dict[str, Any]:
    """The report of all runs. Throughput is the corpus's tokens over the seconds of a whole run."""
    about = sequences.summary(seqs).first().asDict()
    runs = []
    for s in specs:
        mine = seqs.repartition(s.partitions) if s.partitions else seqs
        began = time.monotonic()
        found = RUNNERS[s.kind](mine, s)
        seconds = time.monotonic() - began
        runs.append({"name": s.name, "config": asdict(s), "seconds": seconds, "tokens_per_second": about["tokens"] / seconds if seconds else 0.0, **found})
    return {"timestamp": datetime.now(UTC).isoformat(), "corpus": about | {"sources": list(sources)}, "runs": runs, "scaling": scaling_of(runs)}


def scaling_of(runs: list[dict]) -> list[dict]:
    """Expected throughput and efficiency of the runs that name a reference."""
    rate = {r["name"]: r["tokens_per_second"] for r in runs}
    out = []
    for r in runs:
        c = r["config"]
        if c["reference"] in rate:
            expected = rate[c["reference"]] * c["weight"]
            out.append({"name": r["name"], "reference": c["reference"], "expected": expected, "efficiency": r["tokens_per_second"] / expected if expected else 0.0})
    return out


SCHEMA = {
    "type": "object",
    "required": ["timestamp", "corpus", "runs", "scaling"],
    "properties": {
        "timestamp": {"type": "string"},
        "corpus": {"type": "object", "required": ["sequences", "tokens", "max_length", "sources"], "properties": {n: {"type": "integer", "minimum": 0} for n in ("sequences", "tokens", "max_length")} | {"sources": {"type": "array", "items": {"type": "string"}}}},
        "runs": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/run"}},
        "scaling": {"type": "array", "items": {"type": "object", "required": ["name", "reference", "expected", "efficiency"], "properties": {"expected": {"type": "number", "minimum": 0}, "efficiency": {"type": "number", "minimum": 0}}}},
    },
    "$defs": {"run": {"type": "object", "required": ["name", "config", "seconds", "tokens_per_second"], "properties": {"name": {"type": "string"}, "config": {"type": "object"}, "seconds": {"type": "number", "minimum": 0}, "tokens_per_second": {"type": "number", "minimum": 0}, "vocab": {"type": "integer"}, "merges": {"type": "array"}}}},
}


def save(folder: str, report: dict) -> str:
    """benchmark-<time>.json and summary.md in a folder; a report that breaks the schema is not written."""
    if found := evaluate.violations(report, SCHEMA):
        raise ValueError("; ".join(found))
    path = f"{folder}/benchmark-{report['timestamp'].replace(':', '').replace('+', 'Z')}.json"
    store.write_text(path, json.dumps(report, sort_keys=True))
    store.write_text(f"{folder}/summary.md", table(report))
    return path


def table(report: dict) -> str:
    """The runs, and how they scale, as Markdown."""
    rows = ["| Run | Seconds | Tokens a second | Efficiency |", "| --- | --- | --- | --- |"]
    efficiency = {s["name"]: f"{s['efficiency']:.2f}" for s in report["scaling"]}
    rows += [f"| {r['name']} | {r['seconds']:.2f} | {r['tokens_per_second']:.0f} | {efficiency.get(r['name'], '')} |" for r in report["runs"]]
    return "\n".join([f"{report['corpus']['sequences']} sequences, {report['corpus']['tokens']} tokens", "", *rows, ""])


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(timestamp, name, seconds, tokens_per_second) of all reports in a folder."""
    runs = "array<struct<name:string,seconds:double,tokens_per_second:double>>"
    reports = spark.read.schema(f"timestamp string, runs {runs}").option("pathGlobFilter", "benchmark-*.json").json(folder)
    return reports.select("timestamp", F.explode("runs").alias("r")).select("timestamp", "r.name", "r.seconds", "r.tokens_per_second")


def regressions(spark: SparkSession, folder: str, tolerance: float = 0.1) -> list[str]:
    """The runs whose latest throughput is below the first report's by more than the tolerance."""
    points = history(spark, folder)
    names = [r["name"] for r in points.select("name").distinct().orderBy("name").collect()]
    return [n for n in names if not telemetry.gate(points.where(F.col("name") == n), "timestamp", "tokens_per_second", tolerance)]
