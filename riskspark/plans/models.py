"""Fitted-model store in the shared folder (S7): fit once, later phases load.

The studied pipeline trains in one phase, saves its models, and the
explanation phase loads them instead of training again. The registered
queries work the same way: a fitted model is stored under
``<riskspark.model.dir>/<kind>-<key>`` (default: ``<spark.checkpoint.dir>/riskspark/models``,
the same for every session), where the key
covers

* the input tables' file status (path, length, modification time, listed by
  a Spark file scan without contents, so it works on HDFS / S3 / local alike),
* the fit parameters and the feature list,
* the package source (changed code never reuses an older model).

A missing entry is fitted and stored; ``meta.json`` is written last, so an
entry whose writer died half-way is never read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import pathlib
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import model_dir

META = "meta.json"


@functools.lru_cache(maxsize=1)
def source_digest() -> str:
    root = pathlib.Path(__file__).resolve().parent.parent
    h = hashlib.sha1()
    for p in sorted(root.rglob("*.py")):
        h.update(str(p.relative_to(root)).encode())
        h.update(p.read_bytes())
    return h.hexdigest()


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(sc._jsc.hadoopConfiguration()), jpath


def root_paths(df: DataFrame) -> list[str]:
    """Root folders (or files) of the file tables that the plan scans: a few names, however many files they hold."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("LogicalRelation") and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out.update(roots.apply(k).toString() for k in range(roots.size()))
    return sorted(out)


def input_signature(spark: SparkSession, df: DataFrame) -> list:
    """[files, digest over (file, length, modification time)] of every file the plan scans: listed and
    added up by Spark below the tables' root folders, the contents aren't read."""
    roots = root_paths(df)
    if not roots:
        return [0, 0]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length", "modificationTime")
    digest = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")
    return [str(v) for v in listed.agg(F.count(F.lit(1)), F.sum(digest)).first()]


def model_key(spark: SparkSession, source: DataFrame, kind: str, params: dict, features: Sequence[str]) -> str:
    doc = json.dumps({"kind": kind, "params": params, "features": list(features),
                      "inputs": input_signature(spark, source), "code": source_digest()},
                     sort_keys=True, default=str)
    return hashlib.sha1(doc.encode()).hexdigest()[:20]


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def fit_or_load(spark: SparkSession, source: DataFrame, kind: str, params: dict, features: Sequence[str],
                fit: Callable[[], object]):
    """Return the stored ``TrainedModel`` for (inputs of ``source``, kind, params, features), fitting
    and storing it when absent. ``fit`` is called with no arguments and returns a ``TrainedModel``."""
    from riskspark.operators.train import TrainedModel

    path = f"{model_dir(spark)}/{kind}-{model_key(spark, source, kind, params, features)}"
    meta = _read_text(spark, f"{path}/{META}")
    if meta is not None:
        m = json.loads(meta)
        info = dict(m["info"], loaded_from=path)
        return TrainedModel(m["name"], PipelineModel.load(f"{path}/model"), m["features"], m["params"], info)
    tm = fit()
    tm.model.write().overwrite().save(f"{path}/model")
    _write_text(spark, f"{path}/{META}", json.dumps(
        {"name": tm.name, "features": tm.features, "params": tm.params, "info": tm.info}, default=str))
    return tm
