"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the given tables (through the ``loans`` view) over their
whole extent; float outputs are rounded to 6 places, lists are rendered with
``concat_ws('|')`` so that the DuckDB oracle can compare values.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions import constants as K
from riskspark.functions import scorecard as SC
from riskspark.functions.columns import col, r6
from riskspark.operators import attribute as A
from riskspark.operators import boost as B
from riskspark.operators import clean as C
from riskspark.operators import decide as D
from riskspark.operators import encode as E
from riskspark.operators import evaluate as EV
from riskspark.operators import features as FE
from riskspark.operators import newton as N
from riskspark.operators import profile as P
from riskspark.operators import split as S
from riskspark.operators import train as TR
from riskspark.plans import pipeline as PL
from riskspark.session import materialize, scratch_path, spread
from riskspark.sources import loans as L

MODEL_A = "Logistic Regression"
MODEL_B = "Gradient Boosted Trees"
MODEL_ORDER = [MODEL_A, MODEL_B]


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else col(f.name) for f in df.schema.fields])


# ---- shared plan pieces -------------------------------------------------------

def loans(spark: SparkSession, sf: str) -> DataFrame:
    return L.loans(spark, sf)


def _missing_fit(spark, sf):
    """The loans input (written once to the shared folder: every caller makes several passes)
    and its missing-value plan, which also carries the distinct estimates for later fits."""
    return C.fit_missing_once(loans(spark, sf), "loans-input")


def after_missing(spark, sf) -> DataFrame:
    src, plan = _missing_fit(spark, sf)
    return C.apply_missing(src, plan)


def winsorized(spark, sf) -> DataFrame:
    src, plan = _missing_fit(spark, sf)
    am = C.apply_missing(src, plan)
    return C.apply_winsor(am, C.fit_winsor(am))


def clean_final(spark, sf) -> DataFrame:
    return C.finalize(winsorized(spark, sf))


def fitted_pipeline(spark, sf):
    return PL.fit(loans(spark, sf))


def engineered(spark, sf, scale=True) -> DataFrame:
    fitted, clean_df = fitted_pipeline(spark, sf)
    return PL.transform_clean(clean_df, fitted, scale=scale)


def fixed_scores(df: DataFrame) -> tuple:
    """The two fixed score columns of FIXTURES.md section 4 (model A) and a second, finer one (B)."""
    pa = (F.when(col("fico_n") < 690, F.lit(0.30)).otherwise(F.lit(0.15))
          + F.when(col("dti_n") > 25, F.lit(0.20)).otherwise(F.lit(0.05))
          + F.when(col("loan_amnt") > F.lit(0.4) * col("revenue"), F.lit(0.25)).otherwise(F.lit(0.0)))
    pb = F.lit(0.5) * pa + F.lit(0.5) * (F.lit(850.0) - col("fico_n")) / F.lit(300.0)
    return pa, pb


def split_loans(spark, sf) -> DataFrame:
    base = loans(spark, sf).select("id", "Default", "fico_n", "dti_n", "loan_amnt", "revenue")
    return S.stratified_split(base)


def scored(spark, sf) -> DataFrame:
    """(id, model, split, label, p) for the two fixed-score models; one pass, no union."""
    s = split_loans(spark, sf)
    pa, pb = fixed_scores(s)
    models = F.array(F.struct(F.lit(MODEL_A).alias("model"), pa.alias("p")),
                     F.struct(F.lit(MODEL_B).alias("model"), pb.alias("p")))
    return s.select("id", "split", col("Default").alias("label"), F.inline(models))


def comparison(spark, sf, rounded: bool = True) -> DataFrame:
    return EV.model_comparison(scored(spark, sf), MODEL_ORDER, rounded=rounded)


def applications(spark, sf) -> DataFrame:
    return L.applications(loans(spark, sf))


def valid_applications(spark, sf) -> DataFrame:
    return D.validate(applications(spark, sf)).filter(F.col("is_valid") == 1).drop(
        "errors", "is_valid", "high_dti_warning")


def stored_pipeline(spark, sf) -> PL.FittedPipeline:
    """The published feature pipeline of the loans; fitted and published only where there is none."""
    from riskspark.plans import artifacts

    return artifacts.stored_pipeline(spark, loans(spark, sf))


def served(spark, sf):
    """(applications, stored scaler): serving loads the parameters, it fits nothing."""
    return applications(spark, sf), stored_pipeline(spark, sf).scaler


def scaler(spark, sf) -> E.ScalerParams:
    return stored_pipeline(spark, sf).scaler


def stored_engineered(spark, sf) -> DataFrame:
    """The engineered table by the stored parameters: narrow over the loans, no fit."""
    p = stored_pipeline(spark, sf)
    clean = C.finalize(C.apply_winsor(C.apply_missing(loans(spark, sf), p.missing), p.winsor))
    return PL.transform_clean(clean, p, scale=True)


def _valid(apps: DataFrame) -> DataFrame:
    return D.validate(apps).filter(F.col("is_valid") == 1).drop("errors", "is_valid", "high_dti_warning")


# ---- S: sources and sinks ---------------------------------------------------

def q_scan_loans(spark, sf):
    """Loans written as CSV to the shared folder, scanned back with the declared schema."""
    path = scratch_path(spark, "loans-csv")
    loans(spark, sf).write.option("header", True).csv(path)
    return L.load_csv(spark, path)


def q_roundtrip_loans(spark, sf):
    """Parquet hand-over of the table (write, read back)."""
    path = scratch_path(spark, "loans-parquet")
    loans(spark, sf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def q_dataset_metadata(spark, sf):
    return P.dataset_metadata(loans(spark, sf))


# ---- Q: validation and profile -------------------------------------------------

def q_validate_structure(spark, sf):
    return P.validate_structure(loans(spark, sf))


def q_duplicate_rows(spark, sf):
    return P.duplicate_count(loans(spark, sf))


def q_quality_profile(spark, sf):
    return P.quality_profile(loans(spark, sf))


def q_target_distribution(spark, sf):
    return P.target_distribution(loans(spark, sf))


def q_column_non_null(spark, sf):
    return P.column_non_null(loans(spark, sf))


# ---- C: cleaning and statistics ---------------------------------------------

def q_missing_report(spark, sf):
    return P.missing_report(loans(spark, sf))


def q_clean_missing(spark, sf):
    return _round_doubles(after_missing(spark, sf))


def q_low_cardinality(spark, sf):
    return P.low_cardinality(after_missing(spark, sf))


def q_iqr_outliers(spark, sf):
    return P.iqr_outliers(after_missing(spark, sf))


def q_winsorize(spark, sf):
    return _round_doubles(winsorized(spark, sf))


def q_class_balance(spark, sf):
    return P.class_balance(winsorized(spark, sf))


def q_statistical_summary(spark, sf):
    return P.statistical_summary(winsorized(spark, sf))


def q_top_std(spark, sf):
    return P.top_std(P.statistical_summary(winsorized(spark, sf)))


def q_clean_final(spark, sf):
    return _round_doubles(clean_final(spark, sf))


# ---- F: features --------------------------------------------------------------

def _feature_view(spark, sf, group, cols):
    df = clean_final(spark, sf)
    exprs = group(df)
    return _round_doubles(df.select("id", *cols, *[e.alias(k) for k, e in exprs.items()]))


def q_financial_ratios(spark, sf):
    df = clean_final(spark, sf)
    e = FE.financial_ratios(df)
    return _round_doubles(df.select("id", e["DTI_ratio"].alias("DTI_ratio"), e["loan_to_income"].alias("loan_to_income")))


def q_income_bracket(spark, sf):
    df = clean_final(spark, sf)
    return _round_doubles(df.select("id", "revenue", FE.financial_ratios(df)["income_bracket"].alias("income_bracket")))


def q_temporal_features(spark, sf):
    return _feature_view(spark, sf, FE.temporal_features, ["issue_d"])


def q_employment_features(spark, sf):
    return _feature_view(spark, sf, FE.employment_features, ["emp_length"])


def q_credit_score_features(spark, sf):
    return _feature_view(spark, sf, FE.credit_score_features, ["fico_n"])


def q_purpose_features(spark, sf):
    """Flags per purpose level with its loan count (rows = unique purposes)."""
    df = clean_final(spark, sf)
    e = FE.purpose_features(df)
    return df.groupBy("purpose", e["risky_loan_purpose"].alias("risky_loan_purpose"),
                      e["safe_loan_purpose"].alias("safe_loan_purpose")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_loans"))


def q_home_ownership_features(spark, sf):
    return _feature_view(spark, sf, FE.home_ownership_features, ["home_ownership_n"])


def q_interaction_features(spark, sf):
    df = clean_final(spark, sf)
    cuts = FE.fit_interactions(df)
    e = FE.interaction_features(df, cuts)
    return df.select("id", *[v.alias(k) for k, v in e.items()])


def q_select_features(spark, sf):
    df = clean_final(spark, sf)
    return _round_doubles(FE.select_features(FE.engineer(df, FE.fit_interactions(df))))


def q_one_hot(spark, sf):
    return _round_doubles(engineered(spark, sf, scale=False))


def q_standard_scale(spark, sf):
    return _round_doubles(engineered(spark, sf, scale=True))


def q_scale_check(spark, sf):
    return E.scale_check(engineered(spark, sf, scale=True))


def q_feature_manifest(spark, sf):
    return E.feature_manifest(engineered(spark, sf, scale=True))


# ---- M: split --------------------------------------------------------------------

def q_stratified_split(spark, sf):
    return split_loans(spark, sf).select("id", "Default", "split")


def q_stratified_split_boundary(spark, sf):
    """M1 with 16 buckets per class, so that buckets lie across the cuts: the same split."""
    base = loans(spark, sf).select(K.KEY, K.TARGET)
    return S.stratified_split(base, prefix_len=1).select("id", "Default", "split")


def q_split_summary(spark, sf):
    return S.split_summary(split_loans(spark, sf))


def _train_part(spark, sf):
    return split_loans(spark, sf).filter(F.col("split") == "train")


def q_class_weights(spark, sf):
    return S.class_weights(_train_part(spark, sf))


def q_scale_pos_weight(spark, sf):
    return S.scale_pos_weight(_train_part(spark, sf))


# ---- E: evaluation ----------------------------------------------------------------

def _metrics(spark, sf):
    return EV.metrics(scored(spark, sf))


def q_auc_roc(spark, sf):
    return _metrics(spark, sf).select("model", "split", r6(F.col("auc")).alias("auc"))


def q_auc_roc_buckets(spark, sf):
    """E1 over many value buckets (rows_per_bucket = 16): the plan of very many distinct scores."""
    cum = EV.cumulative_table(scored(spark, sf), rows_per_bucket=16)
    return EV.ranking_metrics(cum).select("model", "split", r6(F.col("auc")).alias("auc"))


def q_gini(spark, sf):
    return _metrics(spark, sf).select("model", "split", r6(F.col("gini")).alias("gini"))


def q_ks_statistic(spark, sf):
    return _metrics(spark, sf).select("model", "split", r6(F.col("ks")).alias("ks"))


def q_roc_curve(spark, sf):
    return EV.roc_curve(EV.cumulative_table(scored(spark, sf)))


def q_classification_metrics(spark, sf):
    m = EV.threshold_metrics(scored(spark, sf))
    return m.select("model", "split", *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def q_confusion_matrix(spark, sf):
    return EV.threshold_metrics(scored(spark, sf)).select("model", "split", "tn", "fp", "fn", "tp")


def q_metric_bands(spark, sf):
    m = _metrics(spark, sf)
    return m.select("model", "split", r6(F.col("gini")).alias("gini"), EV.gini_band(F.col("gini")).alias("gini_band"),
                    r6(F.col("ks")).alias("ks"), EV.ks_band(F.col("ks")).alias("ks_band"))


def q_model_comparison(spark, sf):
    return comparison(spark, sf)


def q_best_model(spark, sf):
    return EV.best_model(comparison(spark, sf, rounded=False))


def q_leaderboard(spark, sf):
    return EV.leaderboard(comparison(spark, sf, rounded=False))


def q_model_info(spark, sf):
    """The model-info record: best model, its test metrics, manifest feature counts."""
    table = engineered(spark, sf, scale=True)
    names = [c for c in table.columns if c != K.KEY]
    n_samples = table.count()
    board = comparison(spark, sf)
    best = EV.best_model(comparison(spark, sf, rounded=False)).select("best_model")
    best_row = board.join(best, board["model_name"] == best["best_model"], "left_semi")
    return best_row.select("model_name", "test_auc", "test_gini", "test_ks",
                           F.lit(len(names) - 1).alias("features_count"),
                           F.lit(len(names)).alias("all_features_count"),
                           F.lit(n_samples).cast("bigint").alias("n_samples"))


# ---- D: decisions -------------------------------------------------------------------

def q_validate_applications(spark, sf):
    v = D.validate(applications(spark, sf))
    return v.select("application_id", F.size("errors").alias("n_errors"), F.concat_ws("|", "errors").alias("errors"),
                    "high_dti_warning", "is_valid")


def q_rejected_applications(spark, sf):
    return D.rejected(applications(spark, sf))


def q_serving_features(spark, sf):
    return _round_doubles(FE.serving_features(valid_applications(spark, sf)))


def q_score_applications(spark, sf):
    apps, sc = served(spark, sf)
    s = D.score_serving(_valid(apps), sc, SC.COEFFICIENTS, SC.INTERCEPT)
    return s.select("application_id", r6(F.col("pd")).alias("pd"))


def q_risk_category(spark, sf):
    apps, sc = served(spark, sf)
    s = D.score_serving(_valid(apps), sc, SC.COEFFICIENTS, SC.INTERCEPT)
    cat, conf, rec = D.risk_band(F.col("pd"))
    return s.select("application_id", r6(F.col("pd")).alias("pd"), cat.alias("risk_category"),
                    conf.alias("confidence_score"), rec.alias("recommendation"))


def q_risk_factors(spark, sf):
    v = valid_applications(spark, sf)
    return v.select("application_id", F.size(D.risk_factors(fallback=False)).alias("n_factors"),
                    F.concat_ws("|", D.risk_factors()).alias("risk_factors"))


def q_risk_factors_basic(spark, sf):
    v = valid_applications(spark, sf)
    f = D.risk_factors_basic()
    return v.select("application_id", F.size(f).alias("n_factors"), F.concat_ws("|", f).alias("risk_factors"))


def q_decisions(spark, sf):
    apps, sc = served(spark, sf)
    d = D.decisions(apps, sc, SC.COEFFICIENTS, SC.INTERCEPT, with_timestamp=False)
    return d.withColumn("risk_factors", F.concat_ws("|", "risk_factors"))


def q_score_numeric_only(spark, sf):
    apps, sc = served(spark, sf)
    s = D.score_serving(_valid(apps), sc, SC.NUMERIC_COEFFICIENTS, SC.NUMERIC_INTERCEPT)
    cat, _, _ = D.risk_band(F.col("pd"))
    return s.select("application_id", r6(F.col("pd")).alias("pd"), cat.alias("risk_category"))


# ---- A: attribution --------------------------------------------------------------------

def _linear_parts(spark, sf):
    from riskspark.session import materialize

    df = materialize(stored_engineered(spark, sf), "explained")  # read for the means, then for the rows
    means = A.feature_means(df, list(SC.COEFFICIENTS))
    return df, means


def q_linear_attribution(spark, sf):
    df, means = _linear_parts(spark, sf)
    c = A.linear_contributions(df, SC.COEFFICIENTS, means)
    return c.select("id", "feature", r6(F.col("contribution")).alias("contribution"))


def q_feature_importance(spark, sf):
    df, means = _linear_parts(spark, sf)
    return A.rank_importance(A.linear_importance(df, SC.COEFFICIENTS, means))


# ---- S: quarantine, partitions, metadata -----------------------------------------------------


def q_scan_loans_counts(spark, sf):
    """S1 with a quarantine: the loans as CSV, with every 50th id's amount spoilt, every 70th id's row cut short and
    every 90th id's date unreadable; the counts of the scan."""
    from riskspark.sources import quarantine

    df = loans(spark, sf)
    path = scratch_path(spark, "loans-broken")
    date = F.when(F.col("id") % 90 == 0, F.lit("some day")).otherwise(F.col("issue_d"))
    amount = F.when(F.col("id") % 50 == 0, F.lit("12x")).otherwise(F.col("loan_amnt").cast("string"))
    df.where("id % 70 <> 0").withColumns({"issue_d": date, "loan_amnt": amount}).write.option("header", True).csv(f"{path}/whole")
    df.where("id % 70 = 0").select("id", "issue_d", "revenue").write.option("header", True).csv(f"{path}/short")
    return quarantine.scan_csv(spark, f"{path}/*").counts()


def q_engineered_by_year(spark, sf):
    """The engineered table partitioned by year of issue; the last year is written again alone; two years read back."""
    from riskspark.operators.features import parse_date
    from riskspark.sources import sinks

    p = stored_pipeline(spark, sf)
    clean = C.finalize(C.apply_winsor(C.apply_missing(loans(spark, sf), p.missing), p.winsor))
    year = F.year(parse_date(F.col("issue_d"))).alias("loan_year")
    table = PL.transform_clean(clean, p).join(clean.select("id", year), "id")
    path = scratch_path(spark, "engineered-by-year")
    sinks.write_partitions(table, path, "loan_year")
    last = spark.read.parquet(path).agg(F.max("loan_year")).first()[0]
    sinks.write_partitions(table.where(F.col("loan_year") == last), path, "loan_year")
    back = spark.read.parquet(path).where(F.col("loan_year") >= last - 1)
    return back.select("id", "Default", "loan_year", r6(F.col("loan_amnt")).alias("loan_amnt"))


def q_column_metadata(spark, sf):
    """Names, types and missing values of the loan table's columns."""
    return P.column_metadata(loans(spark, sf))


def q_split_record(spark, sf):
    """The split's sizes and rates with the seed and shares that define it."""
    return S.split_record(split_loans(spark, sf))


def q_profile_incremental(spark, sf):
    """Q8-Q12 of a table that grows: profiled with three quarters of its files, then again after the rest arrived."""
    from riskspark.operators import incremental as I

    path, store = scratch_path(spark, "growing"), scratch_path(spark, "file-profiles")
    df = loans(spark, sf)
    df.where("id % 4 <> 0").repartition(3).write.parquet(f"{path}/a")
    I.update(spark, path, store, df.columns)
    df.where("id % 4 = 0").repartition(1).write.parquet(f"{path}/b")
    I.update(spark, path, store, df.columns)
    return I.merged_profile(spark, path, store, df.columns).select("column_name", "rows", "non_null", "positives")


# ---- M/E/A with fitted models (rows-only: MLlib fits have no SQL statement) -----------

GBT_ROUNDS = 200       # early stopping keeps the first trees
GRADIENT_TOLERANCE = 1e-3  # of the fit's stopping rule: relative change of the objective below 1e-6


def _model_split(spark, sf):
    from riskspark.plans.pipeline import model_columns

    eng = engineered(spark, sf, scale=True)
    feats = model_columns(eng)
    return S.stratified_split(eng), feats


def _written_split(spark, sf):
    """The split table written once to the shared folder, spread over all cores: fits and scores read it many times."""
    sp, feats = _model_split(spark, sf)
    return spread(sp, "model-split"), feats


def _scores(df, models):
    """(model, split, label, p) of fitted models, written once: a score is computed once, whatever then reads it or filters by it."""
    def of(m):
        p = B.scores(df, m, ["split", "Default"]) if isinstance(m, B.BoostedModel) else df.select("split", "Default", TR.probability_of(m).alias("p"))
        return p.select(F.lit(m.name).alias("model"), "split", col("Default").alias("label"), "p")

    parts = [of(m) for m in models]
    return materialize(functools.reduce(DataFrame.unionByName, parts), "model-scores")


def _load_or_fit(spark, sf, kind, model_type, params, fit, split=None):
    """(model, split): the store is looked up first; ``split()`` gives (split table, features) and runs
    the feature pipeline only when it is called, at most once."""
    from riskspark.plans import artifacts

    split = split or functools.cache(lambda: _written_split(spark, sf))
    payload = artifacts.load_or_fit(spark, loans(spark, sf), kind, params, lambda: asdict(fit(*split())))
    return model_type.from_json(json.dumps(payload)), split


def _part(sp, name):
    return sp.filter(F.col("split") == name)


def _lr(spark, sf, split=None):
    """The balanced L2 logistic regression on the training split: fitted once, then loaded
    from the store (as the explain and scoring phases load the saved model)."""
    return _load_or_fit(spark, sf, "lr", N.LinearModel, {"C": 1.0, "balanced": True},
                        lambda sp, feats: N.fit_logistic(_part(sp, "train"), feats), split)


def q_train_lr(spark, sf):
    """M5: coefficient table of the balanced L2 logistic regression."""
    from riskspark.operators import train as T

    tm, _ = _lr(spark, sf)
    return T.coefficient_table(tm)


def q_tune_lr(spark, sf):
    """M6: 3-fold cross-validated AUC per C."""
    sp, feats = _model_split(spark, sf)
    return N.tune_logistic(_part(sp, "train"), feats)[0]


def q_tune_lr_optimum(spark, sf):
    """M6 checked: for every C and fold, the rows it was fitted on and whether the gradient of its objective is 0 in
    every term."""
    from riskspark.operators.split import stratified_folds
    from riskspark.session import materialize

    sp, feats = _model_split(spark, sf)
    train = materialize(_part(sp, "train"), "tuned-rows")
    _, fits = N.tune_logistic(train, feats)
    folds = materialize(stratified_folds(train), "tuned-folds")
    out = None
    for f in range(K.GRID_FOLDS):
        part = folds.where(F.col("fold") != f)
        counts = {r["Default"]: r["n"] for r in part.groupBy("Default").agg(F.count("*").alias("n")).collect()}
        n, aggs = sum(counts.values()), []
        for c in K.LR_GRID_C:
            m = fits[c, f]
            s = F.when(F.col("Default") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
            e = s * (N.probability(m) - F.col("Default"))
            terms = [F.abs(F.sum(e * col(x)) + F.lit(w / c)) for x, w in zip(feats, m.weights)] + [F.abs(F.sum(e))]
            aggs.append(F.struct(F.lit(float(c)).alias("C"), F.lit(f).alias("fold"), F.count("*").alias("n_train"),
                                 (F.greatest(*terms) / F.lit(float(n)) < 1e-7).cast("int").alias("at_optimum")))
        one = part.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
        out = one if out is None else out.unionByName(one)
    return out


def _gbt(spark, sf, split=None):
    """The early-stopped boosted trees: fitted once, then loaded from the store."""
    return _load_or_fit(spark, sf, "gbt", B.BoostedModel, {"rounds": GBT_ROUNDS, "early_stopping": 20},
                        lambda sp, feats: B.fit_boosted(_part(sp, "train"), _part(sp, "val"), feats, rounds=GBT_ROUNDS), split)


def q_train_gbt(spark, sf):
    """M7: feature importances of the early-stopped boosted trees."""
    tm, _ = _gbt(spark, sf)
    return B.importance_table(tm, spark)


def q_gbt_root_split(spark, sf):
    """M7 checked by value: every feature's best split at the first tree's root over the training split, with the sums and
    leaf weights of both sides."""
    from riskspark.session import materialize

    sp, feats = _model_split(spark, sf)
    out = B.root_splits(materialize(_part(sp, "train"), "root-rows"), feats, bins=16)
    return out.select("feature", r6(F.col("threshold")).alias("threshold"), F.round("gain", 3).alias("gain"), "n_left", "n_right",
                      *[F.round(c, 4).alias(c) for c in ("g_left", "h_left", "left_value", "right_value")])


def q_training_runs(spark, sf):
    """One record per fitted model: sizes and the parameters that depend on the data."""
    lr, split = _lr(spark, sf)
    gbt, _ = _gbt(spark, sf, split)
    sp, _ = split()
    sizes = {r["split"]: r["n"] for r in sp.groupBy("split").count().withColumnRenamed("count", "n").collect()}
    rows = [(tm.name, sizes.get("train", 0), sizes.get("val", 0), len(tm.features), int(tm.params["max_iter"]),
             tm.params.get("regParam"), tm.params.get("scale_pos_weight")) for tm in (lr, gbt)]
    out = spark.createDataFrame(rows, "model_name string, n_train long, n_val long, n_features int, max_iter int, "
                                      "reg_param double, scale_pos_weight double")
    return out.withColumns({"reg_param": F.round("reg_param", 9), "scale_pos_weight": r6(F.col("scale_pos_weight"))})


def q_training_records(spark, sf):
    """What a training leaves behind: rounds or iterations, and the validation metrics of both fitted models."""
    lr, split = _lr(spark, sf)
    gbt, _ = _gbt(spark, sf, split)
    sp, _ = split()
    rounds = spark.createDataFrame([(lr.name, lr.info["iterations"], lr.info["iterations"]), (gbt.name, gbt.info["best_iteration"], gbt.info["fitted_rounds"])],
                                   "model string, best_iteration int, fitted_rounds int")
    found = EV.metrics(_scores(_part(sp, "val"), (lr, gbt))).select("model", *[r6(F.col(c)).alias(f"val_{c}") for c in ("auc", "f1", "precision", "recall")])
    return rounds.join(found, "model")


def q_train_lr_optimum(spark, sf):
    """M5 checked: the gradient of the objective at the fitted coefficients is 0, term by term."""
    from riskspark.operators import train as T

    tm, split = _lr(spark, sf)
    sp, _ = split()
    g = T.logistic_gradient(tm, sp.filter(F.col("split") == "train"))
    return g.select("feature", (F.abs(F.col("gradient")) < GRADIENT_TOLERANCE).cast("int").alias("at_optimum"))


def q_feature_target(spark, sf):
    """S3: label and feature vector of every row (size and sum of the vector)."""
    from pyspark.ml.functions import vector_to_array

    from riskspark.operators import train as T

    xy = T.features_and_target(engineered(spark, sf, scale=True)).withColumn("x", vector_to_array("features"))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return xy.select("id", "label", F.size("x").alias("n_features"), F.round(total, 4).alias("feature_sum"))


def q_stratified_folds(spark, sf):
    """M6/M8: the three folds of the grid searches over the training split."""
    return S.stratified_folds(_train_part(spark, sf)).select("id", "Default", "fold")


def q_evaluate_trained(spark, sf):
    """E1-E9 on the two fitted models' validation and test scores."""
    lr, split = _lr(spark, sf)
    gbt, _ = _gbt(spark, sf, split)
    sp, _ = split()
    return EV.model_comparison(_scores(sp.filter(F.col("split") != "train"), (lr, gbt)), [lr.name, gbt.name])


def q_evaluate_trained_counts(spark, sf):
    """E1-E6 of the fitted models: rows and positives of each split, and whether Gini and the confusion
    counts agree with them."""
    lr, split = _lr(spark, sf)
    gbt, _ = _gbt(spark, sf, split)
    sp, _ = split()
    m = EV.metrics(_scores(sp.filter(F.col("split") != "train"), (lr, gbt)))
    return m.select("model", "split", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("bigint").alias("n"),
                    (F.col("fn") + F.col("tp")).cast("bigint").alias("n_positive"),
                    (F.abs(F.col("gini") - (2 * F.col("auc") - 1)) < 1e-12).cast("int").alias("gini_agrees"),
                    (F.col("auc") > 0.5).cast("int").alias("better_than_chance"))


def q_tree_attribution(spark, sf):
    """A1: per-row log-odds contributions of the boosted trees over the whole table."""
    tm, split = _gbt(spark, sf)
    sp, feats = split()
    return A.tree_attribution(sp, feats, *B.node_table(tm), margin_scale=1.0)


def q_tree_attribution_additive(spark, sf):
    """A1 checked for every row: base value plus contributions is the model's own log-odds."""
    tm, split = _gbt(spark, sf)
    sp, feats = split()
    attr = A.tree_attribution(sp, feats, *B.node_table(tm), margin_scale=1.0)
    total = F.col("base_value")
    for f in feats:
        total = total + col(f"shap_{f}")
    own = sp.select("id", B.margin(tm).alias("log_odds"))
    return attr.select("id", total.alias("total")).join(own, "id").select(
        "id", (F.abs(F.col("total") - F.col("log_odds")) < 1e-6).cast("int").alias("additive"))


def q_tail_sample(spark, sf):
    """A5: the last 1000 rows by id, the explanation sample."""
    return A.tail_sample(engineered(spark, sf, scale=True).select("id", "Default"), 1000)


def q_feature_importance_top(spark, sf):
    """A4: the ten most important features."""
    df, means = _linear_parts(spark, sf)
    return A.rank_importance(A.linear_importance(df, SC.COEFFICIENTS, means), top=10)


def q_linear_attribution_wide(spark, sf):
    """A2 with a column per feature: as many rows as the table."""
    df, means = _linear_parts(spark, sf)
    return _round_doubles(A.linear_contributions_wide(df, SC.COEFFICIENTS, means))


def q_tree_importance(spark, sf):
    """A3/A4 for the boosted trees: mean |contribution| per feature, ranked."""
    tm, split = _gbt(spark, sf)
    sp, feats = split()
    attr = A.tree_attribution(sp, feats, *B.node_table(tm), margin_scale=1.0)
    return A.rank_importance(A.tree_importance(attr, feats))


# ---- D with fitted models --------------------------------------------------------------------


def _best_trained(spark, sf):
    """The fitted model with the greater test AUC (a tie goes to the logistic regression): its name is published once."""
    from riskspark.plans import artifacts

    lr, split = _lr(spark, sf)
    gbt, _ = _gbt(spark, sf, split)
    by_name = {m.name: m for m in (lr, gbt)}

    def choose():
        sp, _ = split()
        auc = {r["model"]: r["auc"] for r in EV.ranking_metrics(EV.cumulative_table(_scores(_part(sp, "test"), (lr, gbt)))).collect()}
        best = gbt if auc[gbt.name] is not None and (auc[lr.name] is None or auc[gbt.name] > auc[lr.name]) else lr
        return {"best_model": best.name, "test_auc": auc}

    return by_name[artifacts.load_or_fit(spark, loans(spark, sf), "best", {"rounds": GBT_ROUNDS}, choose)["best_model"]]


def q_decisions_trained(spark, sf):
    """Decisions of the best fitted model with the stored scaler; no fit and no Python once they are published."""
    apps, sc = served(spark, sf)
    d = D.decide(spread(apps, "applications"), sc, TR.probability_of(_best_trained(spark, sf)), with_timestamp=False)
    return d.withColumn("risk_factors", F.concat_ws("|", "risk_factors"))


def q_decisions_trained_checked(spark, sf):
    """D7, D8 checked for every application under both fitted models: a probability, its band and its recommendation agree."""
    apps, sc = served(spark, sf)
    lr, split = _lr(spark, sf)
    gbt, _ = _gbt(spark, sf, split)
    apps, out = spread(_valid(apps), "applications"), None
    for m in (lr, gbt):
        s = D.score_model(apps, sc, TR.probability_of(m))
        band, _, rec = D.risk_band(F.col("pd"))
        at = F.when(F.col("pd") < 0.10, "Low Risk").when(F.col("pd") < 0.25, "Medium Risk").otherwise("High Risk")
        one = s.select("application_id", F.lit(m.name).alias("model"), ((F.col("pd") > 0) & (F.col("pd") < 1)).cast("int").alias("is_probability"),
                       (band == at).cast("int").alias("band_agrees"), rec.isNotNull().cast("int").alias("decided"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- D14: streaming -------------------------------------------------------------------------

def q_stream_decisions(spark, sf):
    """Applications land as files; a Structured Streaming job (availableNow) decides them."""
    from riskspark.streaming import decisions as STR

    base = scratch_path(spark, "stream")
    apps, sc = served(spark, sf)
    apps.write.mode("overwrite").parquet(f"{base}/incoming")
    q = STR.start(STR.application_stream(spark, f"{base}/incoming"), sc, SC.COEFFICIENTS,
                  SC.INTERCEPT, f"{base}/decisions", f"{base}/rejected", f"{base}/_checkpoint",
                  with_timestamp=False)
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/decisions").drop("_epoch")
    return out.withColumn("risk_factors", F.concat_ws("|", "risk_factors"))


def q_stream_decisions_repeated(spark, sf):
    """D14 with a published model and state: every application arrives twice, in two batches; each is decided once."""
    from riskspark.streaming import decisions as STR
    from riskspark.streaming import serving as SV

    base = scratch_path(spark, "serving")
    apps, sc = served(spark, sf)
    model = N.LinearModel("scorecard", list(SC.COEFFICIENTS), list(SC.COEFFICIENTS.values()), SC.INTERCEPT)
    SV.publish_model(spark, f"{base}/model", model, sc)
    apps.write.parquet(f"{base}/incoming")
    delivered = spark.read.parquet(f"{base}/incoming")
    n_files = len(delivered.inputFiles())  # a file for each task that wrote: a delivery is one micro-batch
    delivered.write.mode("append").parquet(f"{base}/incoming")
    stream = STR.application_stream(spark, f"{base}/incoming", files_per_trigger=n_files)
    SV.start_serving(stream, f"{base}/model", f"{base}/decisions", f"{base}/rejected", f"{base}/_checkpoint", with_timestamp=False).awaitTermination()
    out = spark.read.parquet(f"{base}/decisions").drop("_epoch", "model_version")
    return out.withColumn("risk_factors", F.concat_ws("|", "risk_factors"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
