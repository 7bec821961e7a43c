"""Several tables written together: staged under a run id, made visible by one manifest.

Each table of a run is written to a folder of this attempt's own. The manifest, a small file that names these folders, comes last and is
put in place by a rename; readers look at what manifests name and at nothing else. So a run that fails between two tables
leaves none of them visible, and a second try of a run that has a manifest changes nothing. One job commits a run at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(folder: str, run: str) -> str:
    return f"{folder}/_manifests/{run}.json"


def committed(spark: SparkSession, folder: str, run: str) -> bool:
    path, fs = _files(spark, _manifest(folder, run))
    return fs.exists(path)


def commit(spark: SparkSession, folder: str, run: str, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> bool:
    """Writes the tables of a run and makes them visible together; False if the run is there already, and then nothing is written."""
    if committed(spark, folder, run):
        return False
    attempt = uuid.uuid4().hex
    paths = {}
    for name, table in tables.items():
        df = table() if callable(table) else table
        paths[name] = f"{name}/{run}-{attempt}"
        df.write.parquet(f"{folder}/{paths[name]}")
    staged, fs = _files(spark, f"{_manifest(folder, run)}.{attempt}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps({"run": run, "tables": paths}).encode()))
    out.close()
    final, _ = _files(spark, _manifest(folder, run))
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, False)
        return False
    return True


def visible(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """The rows of a table from all committed runs."""
    manifests, fs = _files(spark, f"{folder}/_manifests")
    if not fs.exists(manifests):
        return spark.createDataFrame([], schema)
    known = spark.read.schema("run string, tables map<string,string>").json(f"{folder}/_manifests/*.json")
    paths = [r[0] for r in known.selectExpr(f"tables['{name}']").where(f"tables['{name}'] is not null").collect()]  # one name a run
    return spark.read.schema(schema).parquet(*[f"{folder}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


def abandoned(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Folders of attempts that no manifest names: what a clean-up may delete once no job is at work."""
    known = spark.read.schema("run string, tables map<string,string>").json(f"{folder}/_manifests/*.json") if _files(spark, f"{folder}/_manifests")[1].exists(_files(spark, f"{folder}/_manifests")[0]) else None
    named = {p for r in known.select("tables").collect() for p in r[0].values()} if known is not None else set()
    out = []
    for name in names:
        path, fs = _files(spark, f"{folder}/{name}")
        out += [f"{name}/{s.getPath().getName()}" for s in (fs.listStatus(path) if fs.exists(path) else [])]
    return sorted(set(out) - named)
