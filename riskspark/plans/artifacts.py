"""Versioned artifacts in the shared folder (S7, D6, S8): fitted parameters and models as JSON.

An artifact's folder holds its versions, each a file that is written under a name of its own and never changed,
and ``CURRENT``, a file with the name of the version in use. A version is complete before ``CURRENT`` names it, and
``CURRENT`` is replaced by an atomic rename. So a reader always finds a whole version, a writer that dies leaves the old
one in use, and of two writers at once the last to rename wins while both versions stay readable.

``load_or_fit`` finds an artifact by what it was fitted on: the input files (path, length, modification time; Spark
lists the tables' own root folders, no list of files passes through Python), the parameters and the package source.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from riskspark.operators import clean as C
from riskspark.operators import encode as E
from riskspark.operators import features as FE
from riskspark.plans import models as M
from riskspark.plans import pipeline as PL
from riskspark.session import model_dir

CURRENT = "CURRENT"


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Atomic rename that replaces the target."""
    jvm = spark.sparkContext._jvm
    path, fs = jvm.org.apache.hadoop.fs.Path, getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(fs, 1)
    options[0] = fs.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(path(source), path(target), options)


def publish(spark: SparkSession, folder: str, payload: dict) -> str:
    """Write ``payload`` as a new version and make it the current one; returns the version's name."""
    version = uuid.uuid4().hex
    M._write_text(spark, f"{folder}/{version}.json", json.dumps(payload))  # the order of keys is kept: one-hot levels have one
    M._write_text(spark, f"{folder}/_{version}", version)
    _rename(spark, f"{folder}/_{version}", f"{folder}/{CURRENT}")
    return version


def current_version(spark: SparkSession, folder: str) -> str | None:
    return M._read_text(spark, f"{folder}/{CURRENT}")


def read(spark: SparkSession, folder: str, version: str | None = None) -> dict | None:
    """The payload in use (or of ``version``); None where nothing was published."""
    version = version or current_version(spark, folder)
    return None if version is None else json.loads(M._read_text(spark, f"{folder}/{version}.json"))


def folder_of(spark: SparkSession, source: DataFrame, kind: str, params: dict) -> str:
    return f"{model_dir(spark)}/{kind}-{M.model_key(spark, source, kind, params, [])}"


def load_or_fit(spark: SparkSession, source: DataFrame, kind: str, params: dict, fit: Callable[[], dict]) -> dict:
    """The payload fitted on the files of ``source`` with ``params``: read if it was published, else fitted and published."""
    folder = folder_of(spark, source, kind, params)
    found = read(spark, folder)
    if found is None:
        found = fit()
        publish(spark, folder, found)
    return found


def pipeline_payload(p: PL.FittedPipeline) -> dict:
    return {"missing": asdict(p.missing), "winsor": {k: list(v) for k, v in p.winsor.bounds.items()}, "cuts": asdict(p.cuts), "levels": p.levels, "scaler": asdict(p.scaler)}


def pipeline_of(payload: dict) -> PL.FittedPipeline:
    return PL.FittedPipeline(C.MissingPlan(**payload["missing"]), C.WinsorBounds({k: tuple(v) for k, v in payload["winsor"].items()}),
                             FE.InteractionCuts(**payload["cuts"]), payload["levels"], E.ScalerParams(**payload["scaler"]))


def stored_pipeline(spark: SparkSession, loans: DataFrame) -> PL.FittedPipeline:
    """The fitted feature pipeline of ``loans``: read, or fitted once and published. No job runs over the rows when it is read."""
    return pipeline_of(load_or_fit(spark, loans, "pipeline", {"fit_on": "all"}, lambda: pipeline_payload(PL.fit(loans)[0])))
