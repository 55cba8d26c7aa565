"""End-to-end phases as Spark jobs (what a user runs phase by phase).

    python -m riskspark.plans.jobs all --sf-dir /root/testdata/sf0.1 --out <shared path>
    python -m riskspark.plans.jobs all --loans <loans table> --format csv --out <shared path>

Each phase also runs alone: it reads what the phases before it left under ``--out``.

Phases and their outputs under ``--out``:

* ``load``      dataset validation + quality profile  -> ``metadata/dataset`` (JSON), ``reports/validation``
* ``eda``       missing report, IQR report, summary   -> ``tables/cleaned`` (Parquet), ``reports/*`` (CSV)
* ``features``  engineered 43-column table            -> ``tables/engineered`` (Parquet), ``metadata/features``
* ``train``     split, LR + GBT, evaluation           -> ``tables/split``, ``models/*``, ``reports/model_comparison``, ``metadata/models``
* ``explain``   tree attribution importance           -> ``reports/feature_importance``
* ``score``     batch decisions for an applications table -> ``tables/decisions``, ``tables/rejected``

Every table stays distributed; only small reports (one CSV file each) and
one-row metadata records are written by a single task.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import constants as K
from riskspark.operators import attribute as A
from riskspark.operators import boost as B
from riskspark.operators import decide as D
from riskspark.operators import evaluate as EV
from riskspark.operators import newton as N
from riskspark.operators import profile as P
from riskspark.operators import split as S
from riskspark.operators import train as T
from riskspark.operators.encode import ScalerParams
from riskspark.plans import artifacts
from riskspark.plans import pipeline as PL
from riskspark.sources import loans as L
from riskspark.session import materialize
from riskspark.sources import sinks
from riskspark.streaming import serving as SV


def load_loans(spark: SparkSession, loans_path: str | None = None, sf_dir: str | None = None,
               source_format: str = "parquet") -> DataFrame:
    if loans_path:
        return L.load_csv(spark, loans_path) if source_format == "csv" else spark.read.parquet(loans_path)
    if sf_dir:
        return L.loans(spark, sf_dir)
    raise ValueError("give --loans or --sf-dir")


def phase_load(spark: SparkSession, loans: DataFrame, out: str) -> dict:
    validation = P.validate_structure(loans)
    sinks.write_report_csv(validation, f"{out}/reports/validation")
    meta = P.dataset_metadata(loans)
    sinks.write_metadata_json(meta, f"{out}/metadata/dataset")
    v = validation.filter(F.col("check") == "is_valid").first()
    return {"is_valid": bool(v["ok"])}


def phase_eda(spark: SparkSession, loans: DataFrame, out: str) -> DataFrame:
    source, missing = PL.C.fit_missing_once(loans, "eda-input")
    sinks.write_report_csv(P.missing_report(source), f"{out}/reports/missing")
    after = PL.C.apply_missing(source, missing)
    sinks.write_report_csv(P.iqr_outliers(after), f"{out}/reports/outliers")
    winsor = PL.C.fit_winsor(after)
    clean_df = PL.C.finalize(PL.C.apply_winsor(after, winsor))
    sinks.write_report_csv(P.statistical_summary(clean_df), f"{out}/reports/statistical_summary")
    sinks.write_table(clean_df, f"{out}/tables/cleaned")
    return spark.read.parquet(f"{out}/tables/cleaned")


def phase_features(spark: SparkSession, cleaned: DataFrame, out: str) -> tuple[DataFrame, PL.FittedPipeline]:
    """Features on the cleaned table (no second cleaning): one fused fit pass, then one projection."""
    cuts, levels, scaler = PL.fit_features(cleaned)
    fitted = PL.FittedPipeline(PL.C.MissingPlan(), PL.C.WinsorBounds({}), cuts, levels, scaler)
    eng = PL.transform_clean(cleaned, fitted)
    sinks.write_table(eng, f"{out}/tables/engineered")
    record = {"all_features": [c for c in eng.columns if c != K.KEY],
              "numeric_features": K.NUMERIC_FEATURES, "binary_features": K.BINARY_FEATURES,
              "categorical_features": K.CATEGORICAL_FEATURES, "target": K.TARGET,
              "n_features": len(PL.model_columns(eng)),
              "scaler": {"mean": scaler.mean, "std": scaler.std}, "levels": levels,
              "interaction_cuts": vars(cuts)}
    sinks.write_metadata_json(sinks.metadata_record(spark, record), f"{out}/metadata/features")
    return spark.read.parquet(f"{out}/tables/engineered"), fitted


def phase_train(spark: SparkSession, engineered: DataFrame, out: str, gbt_rounds: int = 200) -> dict:
    feats = PL.model_columns(engineered)
    sinks.write_table(S.stratified_split(engineered), f"{out}/tables/split")  # the split is fixed on storage
    split = spark.read.parquet(f"{out}/tables/split")
    sinks.write_report_csv(S.split_summary(split), f"{out}/reports/splits")
    train = split.filter(F.col("split") == "train")
    val = split.filter(F.col("split") == "val")
    n_train, n_val = train.count(), val.count()
    lr = N.fit_logistic(train, feats)
    gbt = B.fit_boosted(train, val, feats, rounds=gbt_rounds)
    artifacts.publish(spark, f"{out}/models/logistic_regression", asdict(lr))
    artifacts.publish(spark, f"{out}/models/gradient_boosted_trees", asdict(gbt))
    held_out = split.filter(F.col("split") != "train")
    parts = [T.score(tm, held_out, keep=[K.KEY, "split", K.TARGET]).select(
        F.lit(tm.name).alias("model"), "split", F.col(K.TARGET).alias("label"), "p") for tm in (lr, gbt)]
    exact = EV.model_comparison(parts[0].unionByName(parts[1]), [lr.name, gbt.name], rounded=False)
    exact = materialize(exact, "comparison")  # a row for each model
    metrics = [f"{s}_{m}" for s in ("val", "test") for m in EV.METRICS]
    sinks.write_report_csv(exact.withColumns({m: EV.r6(F.col(m)) for m in metrics}), f"{out}/reports/model_comparison")
    best = EV.best_model(exact).first()
    scaler = ScalerParams(**sinks.read_record(spark, f"{out}/metadata/features")["scaler"])
    SV.publish_model(spark, f"{out}/models/serving", gbt if best["best_model"] == gbt.name else lr, scaler)  # what scoring uses from now on
    by_model = {r["model_name"]: {m: r[m] for m in metrics} for r in exact.collect()}
    fields = ["model_name", "n_train", "n_val", "params", "best_iteration", "train_seconds"]
    record = {"best_model": best["best_model"], "version": K.MODEL_VERSION,
              "training_date": datetime.now(timezone.utc).date().isoformat(),
              "performance": {"auc_roc": best["best_auc"], "gini": best["best_gini"], "ks_statistic": best["best_ks"]},
              "runs": [dict(zip(fields, T.run_record(tm, n_train, n_val)), metrics=by_model.get(tm.name)) for tm in (lr, gbt)]}
    sinks.write_metadata_json(sinks.metadata_record(spark, record), f"{out}/metadata/models")
    return {"best_model": best["best_model"], "lr": lr, "gbt": gbt, "features": feats}


def model_info(spark: SparkSession, out: str) -> DataFrame:
    """The model-info record (one row) from the metadata that ``features`` and ``train`` left.

    Without ``metadata/features`` there is no model to describe: an error. Without ``metadata/models``, or for
    a field that it lacks, the fixed fallback values hold; the performance is then not that of a model here.
    """
    features = sinks.read_record(spark, f"{out}/metadata/features")
    if not features:
        raise ValueError(f"no model information under {out}: run the features phase first")
    stored = sinks.read_record(spark, f"{out}/metadata/models")
    models = stored or K.MODEL_INFO_FALLBACK
    row = (K.MODEL_DISPLAY_NAME, models.get("version", K.MODEL_INFO_FALLBACK["version"]), models.get("best_model"),
           models.get("training_date", K.MODEL_INFO_FALLBACK["training_date"]), len(features.get("all_features", [])),
           models.get("performance", {}), bool(stored))
    return spark.createDataFrame([row], "model_name string, version string, algorithm string, training_date string, "
                                        "features_count int, performance_metrics map<string,double>, from_metadata boolean")


def phase_explain(spark: SparkSession, engineered: DataFrame, out: str) -> None:
    gbt = B.BoostedModel.from_json(json.dumps(artifacts.read(spark, f"{out}/models/gradient_boosted_trees")))
    attr = A.tree_attribution(engineered, gbt.features, *B.node_table(gbt), margin_scale=1.0)
    sinks.write_report_csv(A.rank_importance(A.tree_importance(attr, gbt.features)), f"{out}/reports/feature_importance")


def phase_score(spark: SparkSession, applications: DataFrame, out: str) -> None:
    """Decisions by the published model and scaler: the best model of the last training."""
    _, model, scaler = SV.published_model(spark, f"{out}/models/serving")
    sinks.write_table(D.decide(applications, scaler, T.probability_of(model)), f"{out}/tables/decisions")
    sinks.write_table(D.rejected(applications), f"{out}/tables/rejected")


def run_all(spark: SparkSession, loans: DataFrame, out: str, gbt_rounds: int = 200,
            applications: DataFrame | None = None) -> dict:
    """All phases; scoring uses the stored scaler and the best model of those fitted here."""
    status = phase_load(spark, loans, out)
    cleaned = phase_eda(spark, loans, out)
    engineered, _ = phase_features(spark, cleaned, out)
    trained = phase_train(spark, engineered, out, gbt_rounds=gbt_rounds)
    phase_explain(spark, engineered, out)
    if applications is not None:
        phase_score(spark, applications, out)
    status["best_model"] = trained["best_model"]
    return status


def run_phase(spark: SparkSession, phase: str, out: str, loans: Callable[[], DataFrame],
              applications: DataFrame | None = None, gbt_rounds: int = 200):
    """One phase alone, from the tables, models and metadata of earlier phases under ``out``."""
    if phase == "load":
        return phase_load(spark, loans(), out)
    if phase == "eda":
        return phase_eda(spark, loans(), out)
    if phase == "features":
        return phase_features(spark, spark.read.parquet(f"{out}/tables/cleaned"), out)
    engineered = spark.read.parquet(f"{out}/tables/engineered")
    feats = PL.model_columns(engineered)
    if phase == "train":
        return phase_train(spark, engineered, out, gbt_rounds=gbt_rounds)
    if phase == "explain":
        return phase_explain(spark, engineered, out)
    if phase == "score":
        return phase_score(spark, L.applications(loans()) if applications is None else applications, out)
    raise ValueError(f"unknown phase {phase}")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="riskspark.plans.jobs")
    ap.add_argument("phase", choices=["all", "load", "eda", "features", "train", "explain", "score"])
    ap.add_argument("--loans")
    ap.add_argument("--format", choices=["parquet", "csv"], default="parquet", help="of --loans")
    ap.add_argument("--sf-dir")
    ap.add_argument("--applications", help="Parquet table to score; default: the applications view of the loans")
    ap.add_argument("--out", required=True)
    ap.add_argument("--gbt-rounds", type=int, default=200)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()

    def loans() -> DataFrame:
        return load_loans(spark, args.loans, args.sf_dir, args.format)

    apps = spark.read.parquet(args.applications) if args.applications else None
    if args.phase == "all":
        table = loans()
        print(json.dumps(run_all(spark, table, args.out, args.gbt_rounds, L.applications(table) if apps is None else apps)))
    else:
        run_phase(spark, args.phase, args.out, loans, apps, args.gbt_rounds)


if __name__ == "__main__":
    main()
