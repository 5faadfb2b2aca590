"""A generation run from contract to manifest, and its replay."""

from __future__ import annotations

import json
import platform
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators import checks, edge, scale
from facsimile.plans import generate, packs
from facsimile.plans.contract import Contract
from facsimile.sources import writers


@dataclass(frozen=True)
class RunConfig:
    seed: int = 42
    locale: str = "us"
    rows: dict[str, int] = field(default_factory=dict)
    pack: str | None = None
    pack_args: dict[str, Any] = field(default_factory=dict)
    edge_cases: bool = False
    edge_case_rate: float = 0.02
    formats: tuple[str, ...] = ("parquet",)


@dataclass
class Run:
    tables: dict[str, DataFrame]
    checks: list[dict]
    manifest: dict[str, Any]

    def manifest_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(json.dumps(self.manifest, sort_keys=True),)], "manifest string")


def build_tables(spark: SparkSession, contract: Contract, config: RunConfig) -> dict[str, DataFrame]:
    if config.pack:
        return packs.pack(config.pack)["generate"](spark, config.seed, locale=config.locale, **config.pack_args)
    return generate.generate_from_contract(spark, contract, config.rows, config.seed, config.locale)


def execute_run(spark: SparkSession, contract: Contract, config: RunConfig, folder: str | None = None) -> Run:
    """Generate, optionally damage, prove, export; one manifest describes it all."""
    timings: dict[str, int] = {}

    def timed(name: str, fn):
        t0 = time.time()
        out = fn()
        timings[f"{name}_ms"] = int((time.time() - t0) * 1000)
        return out

    def make() -> dict[str, DataFrame]:
        # each table is written once to the shared folder: checks, exports and hashes all read it
        return {n: scale.cut(d) for n, d in build_tables(spark, contract, config).items()}

    tables = timed("generate", make)
    if config.edge_cases:
        for t in contract.tables:
            kinds = {c.name: c.kind for c in t.columns}
            if t.name in tables and t.key:
                tables[t.name], _, _ = edge.inject_all(tables[t.name], kinds, t.key,
                                                       {"anomaly_rate": config.edge_case_rate}, config.seed)

    def prove() -> list[dict]:
        todo = packs.pack(config.pack)["checks"]() if config.pack else []
        todo = todo + checks.link_checks(contract.links(tables)) + checks.contract_checks(contract.constraints())
        rules = checks.declared_rules(contract.rules, {t.name: t.key for t in contract.tables})
        return [r.asDict() for r in checks.run_rules(tables, [*todo, *rules]).collect()]  # one row per check

    results = timed("validate", prove)
    prints = {n: writers.fingerprint(d).first().asDict() for n, d in tables.items()}
    artifacts: list[dict] = []
    if folder:
        timed("export", lambda: writers.export_all(tables, folder, config.formats))
        paths = [f"{folder}/{n}.{f}" for n in tables for f in config.formats]
        listed = writers.artifact_manifest(spark, paths)
        per = listed.groupBy("name", "format").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"),
                                                   F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256"))
        artifacts = [r.asDict() for r in per.collect()]  # one row per table and format
    total_ms = sum(timings.values())
    total_rows = sum(p["rows"] for p in prints.values())
    manifest = {
        "run_id": uuid.uuid4().hex[:12], "contract_hash": contract.fingerprint(), "seed": config.seed,
        "generation_mode": contract.mode, "domain": contract.domain, "locale": config.locale,
        "config": asdict(config),
        "timings": {**timings, "total_ms": total_ms, "rows_per_second": round(total_rows / max(total_ms / 1000, 0.001), 1)},
        "tables": {n: {"rows": prints[n]["rows"], "columns": len(d.columns), "fingerprint": prints[n]["fingerprint"]}
                   for n, d in tables.items()},
        "artifacts": artifacts, "checks": results,
        "software": {"python": platform.python_version(), "pyspark": pyspark.__version__},
    }
    return Run(tables, results, manifest)


def replay(spark: SparkSession, contract: Contract, manifest: dict[str, Any]) -> DataFrame:
    """Generate again from a manifest and compare every table's fingerprint: (table, expected, actual, same)."""
    raw = dict(manifest["config"])
    raw["formats"] = tuple(raw["formats"])
    config = RunConfig(**raw)
    if config.edge_cases:
        tables = execute_run(spark, contract, config).tables
    else:
        tables = build_tables(spark, contract, config)
    found = {n: writers.fingerprint(tables[n]).first()["fingerprint"] for n in manifest["tables"]}
    rows = [(n, t["fingerprint"], found[n], t["fingerprint"] == found[n]) for n, t in manifest["tables"].items()]
    return spark.createDataFrame(rows, "table string, expected string, actual string, same boolean")


def all_passed(results: Sequence[dict]) -> bool:
    return all(r["passed"] for r in results)
