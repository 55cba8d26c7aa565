"""DuckDB SQL oracles: for each value-checked query, the same result stated in SQL.

The SQL is assembled from a chain of CTEs (loans -> cleaned -> winsorized ->
clean_final -> features -> encoded -> scaled; split -> scored; applications).
Data-dependent column sets (which columns the missing-value rule drops or
fills, which one-hot levels exist) are the decisions the ``missing_report``
and ``one_hot`` queries themselves produce on the fixture; the row-level work
is all computed here.
"""

from __future__ import annotations

from riskspark.functions import constants as K
from riskspark.functions import scorecard as SC
from riskspark.operators.features import SERVING_PURPOSE_LEVELS
from riskspark.sources.loans import LOAN_COLUMNS, NA_TOKENS

MODEL_A = "Logistic Regression"
MODEL_B = "Gradient Boosted Trees"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def R6(x: str) -> str:
    return f"(ROUND(CAST({x} AS DOUBLE), 6) + 0.0E0)"


def flag(cond: str) -> str:
    return f"CAST(COALESCE({cond}, FALSE) AS INTEGER)"


def num(v) -> str:
    return f"{float(v)!r}E0" if "e" not in repr(float(v)) else repr(float(v))


LOANS = """loans AS (
  WITH li AS (
    SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey
  ), base AS (
    SELECT o_orderkey AS id,
           CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS issue_d,
           CASE WHEN c_acctbal < -900 THEN 0.0E0 ELSE 20000.0E0 + 12.0E0 * GREATEST(c_acctbal, 0.0E0) END AS revenue,
           qty / 5.0E0 AS dti_n,
           CAST(FLOOR(o_totalprice / 350.0E0) AS BIGINT) * 25 + 1000 AS loan_amnt,
           CAST(CASE WHEN o_orderkey % 50 = 0 THEN 560
                ELSE 662 + 5 * ((o_orderkey * 37 + c_custkey * 11) % 29) END AS DOUBLE) AS fico_n,
           CAST(1 AS BIGINT) AS experience_c,
           CASE c_custkey % 13 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 2 THEN '2 years'
                WHEN 3 THEN '3 years' WHEN 4 THEN '4 years' WHEN 5 THEN '5 years' WHEN 6 THEN '6 years'
                WHEN 7 THEN '7 years' WHEN 8 THEN '8 years' WHEN 9 THEN '9 years' WHEN 10 THEN '10+ years'
                WHEN 11 THEN 'n/a' ELSE 'NI' END AS emp_length,
           CASE (o_orderkey * 5 + c_custkey) % 14 WHEN 0 THEN 'car' WHEN 1 THEN 'credit_card'
                WHEN 2 THEN 'debt_consolidation' WHEN 3 THEN 'educational' WHEN 4 THEN 'home_improvement'
                WHEN 5 THEN 'house' WHEN 6 THEN 'major_purchase' WHEN 7 THEN 'medical' WHEN 8 THEN 'moving'
                WHEN 9 THEN 'other' WHEN 10 THEN 'renewable_energy' WHEN 11 THEN 'small_business'
                WHEN 12 THEN 'vacation' ELSE 'wedding' END AS purpose,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'OWN' WHEN 'FURNITURE' THEN 'OTHER'
                WHEN 'MACHINERY' THEN 'RENT' ELSE 'MORTGAGE' END AS home_ownership_n,
           n_name AS addr_state,
           CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE 'Z' || CAST(c_custkey % 900 + 100 AS VARCHAR(3)) END AS zip_code,
           CASE WHEN o_orderkey % 81 = 0 THEN NULL ELSE o_orderpriority END AS title,
           CASE WHEN o_orderkey % 11 <> 0 THEN NULL ELSE c_name END AS "desc",
           (o_orderkey * 7919 + c_custkey * 104729) % 100 AS noise
    FROM orders JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey
         LEFT JOIN li ON l_orderkey = o_orderkey
  )
  SELECT id, issue_d, revenue, dti_n, loan_amnt, fico_n, experience_c, emp_length, purpose,
         home_ownership_n, addr_state, zip_code,
         CAST(CASE WHEN noise < 8 + CASE WHEN fico_n < 690 THEN 12 ELSE 0 END
                   + CASE WHEN dti_n > 25 THEN 10 ELSE 0 END
                   + CASE WHEN loan_amnt > 0.4E0 * revenue THEN 15 ELSE 0 END
              THEN 1 ELSE 0 END AS BIGINT) AS "Default",
         title, "desc"
  FROM base
)"""

TEXT_COLS = ["issue_d", "emp_length", "purpose", "home_ownership_n", "addr_state", "zip_code", "title", "desc"]
NUMERIC_LOAN_COLS = ["id", "revenue", "dti_n", "loan_amnt", "fico_n", "experience_c", "Default"]
DTYPE = {"id": "int64", "revenue": "float64", "dti_n": "float64", "loan_amnt": "int64", "fico_n": "float64",
         "experience_c": "int64", "Default": "int64"}

# The decisions the missing-value rule takes on the fixture (see the missing_report oracle).
CLEAN_COLS = [c for c in LOAN_COLUMNS if c != "desc"]
FILLED = ["zip_code", "title"]
WINSOR_COLS = ["revenue", "dti_n", "loan_amnt", "fico_n", "experience_c"]
CLEAN_TEXT = [c for c in CLEAN_COLS if c in TEXT_COLS]

CLEANED = "cleaned AS (SELECT " + ", ".join(
    f"COALESCE({q(c)}, 'Unknown') AS {q(c)}" if c in FILLED else q(c) for c in CLEAN_COLS
) + " FROM loans WHERE dti_n IS NOT NULL)"

WB = "wb AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in WINSOR_COLS) + " FROM cleaned)"

WINSORIZED = "winsorized AS (SELECT " + ", ".join(
    (f"CAST(CASE WHEN {c} IS NULL THEN NULL ELSE LEAST(GREATEST({c}, {c}_lo), {c}_hi) END AS DOUBLE) AS {c}"
     if c in WINSOR_COLS else q(c)) for c in CLEAN_COLS) + " FROM cleaned, wb)"

CLEAN_FINAL = ("clean_final AS (SELECT * FROM winsorized WHERE \"Default\" IS NOT NULL AND "
               + " AND ".join(f"COALESCE(NOT isinf({c}), TRUE)" for c in WINSOR_COLS) + ")")

FQ = ("fq AS (SELECT quantile_cont(dti_n, 0.75) AS dti75, quantile_cont(loan_amnt, 0.75) AS loan75, "
      "quantile_cont(fico_n, 0.25) AS fico25 FROM clean_final)")


def right_closed(x: str, edges, labels) -> str:
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = f"{x} > {num(lo)}" + ("" if hi == float("inf") else f" AND {x} <= {num(hi)}")
        parts.append(f"WHEN {cond} THEN {s(lab)}")
    return "CASE " + " ".join(parts) + " END"


def left_closed(x: str, edges, labels) -> str:
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = f"{x} >= {num(lo)}" + ("" if hi == float("inf") else f" AND {x} < {num(hi)}")
        parts.append(f"WHEN {cond} THEN {s(lab)}")
    return "CASE " + " ".join(parts) + " END"


EMP_CASE = ("CAST(COALESCE(CASE emp_length " + " ".join(f"WHEN {s(k)} THEN {v}" for k, v in K.EMP_LENGTH_YEARS.items())
            + " END, 0) AS INTEGER)")
DATE_EXPR = "COALESCE(TRY_STRPTIME(issue_d, '%Y-%m-%d'), TRY_STRPTIME(issue_d, '%b-%Y'))"
INCOME_CASE = right_closed("revenue", K.INCOME_EDGES, K.INCOME_LABELS)
FICO_CASE = right_closed("fico_n", K.FICO_EDGES, K.FICO_LABELS)

F1 = f"""f1 AS (SELECT *, dti_n AS DTI_ratio,
  LEAST(GREATEST(CASE WHEN revenue > 0 THEN loan_amnt / revenue ELSE 0.0E0 END, 0.0E0), 10.0E0) AS loan_to_income,
  {INCOME_CASE} AS income_bracket,
  CAST(year({DATE_EXPR}) AS INTEGER) AS issue_year,
  CAST(month({DATE_EXPR}) AS INTEGER) AS issue_month,
  CAST(quarter({DATE_EXPR}) AS INTEGER) AS issue_quarter,
  {EMP_CASE} AS emp_length_numeric,
  {FICO_CASE} AS fico_bracket,
  {flag("fico_n >= 740")} AS high_fico,
  {flag("purpose IN (" + ", ".join(s(x) for x in K.RISKY_PURPOSES) + ")")} AS risky_loan_purpose,
  {flag("purpose IN (" + ", ".join(s(x) for x in K.SAFE_PURPOSES) + ")")} AS safe_loan_purpose,
  {flag("home_ownership_n = 'OWN'")} AS is_homeowner,
  {flag("home_ownership_n = 'MORTGAGE'")} AS has_mortgage,
  {flag("home_ownership_n = 'RENT'")} AS is_renter
FROM clean_final)"""

FEAT = f"""feat AS (SELECT f1.*, {flag("emp_length_numeric >= 3")} AS employment_stable,
  {flag("dti_n > dti75 AND income_bracket IN ('<25K', '25K-50K')")} AS high_debt_low_income,
  {flag("loan_amnt > loan75 AND fico_n < fico25")} AS high_loan_low_fico
FROM f1, fq)"""

SELECTED_COLS = ["id"] + K.NUMERIC_FEATURES + K.BINARY_FEATURES + K.CATEGORICAL_FEATURES + ["Default"]
SELECTED = "selected AS (SELECT " + ", ".join(q(c) for c in SELECTED_COLS) + " FROM feat)"

# The one-hot levels the fit finds on the fixture: sorted observed text levels, declared bracket labels.
LEVELS = {
    "purpose": SERVING_PURPOSE_LEVELS,
    "home_ownership_n": ["MORTGAGE", "OTHER", "OWN", "RENT"],
    "income_bracket": K.INCOME_LABELS,
    "fico_bracket": K.FICO_LABELS,
}
DUMMIES = [(c, lv, f"{c}_{lv}") for c, levels in LEVELS.items() for lv in levels[1:]]
ENC_COLS = ["id"] + K.NUMERIC_FEATURES + K.BINARY_FEATURES + ["Default"] + [d for _, _, d in DUMMIES]
ENCODED = ("encoded AS (SELECT " + ", ".join(q(c) for c in ["id"] + K.NUMERIC_FEATURES + K.BINARY_FEATURES + ["Default"])
           + ", " + ", ".join(f"{flag(f'{q(c)} = {s(lv)}')} AS {q(d)}" for c, lv, d in DUMMIES) + " FROM selected)")

SC_STATS = "sc AS (SELECT " + ", ".join(
    f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in K.NUMERIC_FEATURES) + " FROM encoded)"


def _scaled_expr(c: str, src: str = "") -> str:
    x = f"{src}{q(c)}"
    return f"(CAST({x} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0E0 ELSE s_{c} END)"


SCALED = "scaled AS (SELECT " + ", ".join(
    f"{_scaled_expr(c)} AS {q(c)}" if c in K.NUMERIC_FEATURES else q(c) for c in ENC_COLS) + " FROM encoded, sc)"

# ---- split -------------------------------------------------------------------------

SPLIT = """split_base AS (SELECT id, "Default", fico_n, dti_n, loan_amnt, revenue,
    md5(CAST(id AS VARCHAR) || '|42') AS h FROM loans),
cls AS (SELECT "Default" AS lab, COUNT(*) AS n_c FROM split_base GROUP BY 1),
tot AS (SELECT CAST(SUM(n_c) AS BIGINT) AS n, CAST(CEIL(0.2E0 * SUM(n_c)) AS BIGINT) AS n_test FROM cls),
a1 AS (SELECT lab, n_c, n, n_test, (n_c * (n - n_test)) // n AS k_floor, (n_c * (n - n_test)) % n AS k_rem FROM cls, tot),
a1r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY k_rem DESC, lab) AS rr,
        (n - n_test) - CAST(SUM(k_floor) OVER () AS BIGINT) AS need FROM a1),
keep AS (SELECT lab, n_c, k_floor + CASE WHEN rr <= need THEN 1 ELSE 0 END AS keep_c FROM a1r),
tot2 AS (SELECT CAST(SUM(keep_c) AS BIGINT) AS nt, CAST(CEIL(0.25E0 * SUM(keep_c)) AS BIGINT) AS n_val FROM keep),
a2 AS (SELECT lab, n_c, keep_c, nt, n_val, (keep_c * (nt - n_val)) // nt AS t_floor,
        (keep_c * (nt - n_val)) % nt AS t_rem FROM keep, tot2),
a2r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY t_rem DESC, lab) AS rr,
        (nt - n_val) - CAST(SUM(t_floor) OVER () AS BIGINT) AS need FROM a2),
sizes AS (SELECT lab, n_c - keep_c AS n_test_c,
          keep_c - (t_floor + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS n_val_c FROM a2r),
ranked AS (SELECT b.*, ROW_NUMBER() OVER (PARTITION BY "Default" ORDER BY h, id) - 1 AS rk FROM split_base b),
split AS (SELECT r.id, r."Default", r.fico_n, r.dti_n, r.loan_amnt, r.revenue,
          CASE WHEN rk < n_test_c THEN 'test' WHEN rk < n_test_c + n_val_c THEN 'val' ELSE 'train' END AS split
          FROM ranked r JOIN sizes z ON r."Default" = z.lab)"""

PA = ("(CASE WHEN fico_n < 690 THEN 0.30E0 ELSE 0.15E0 END + CASE WHEN dti_n > 25 THEN 0.20E0 ELSE 0.05E0 END"
      " + CASE WHEN loan_amnt > 0.4E0 * revenue THEN 0.25E0 ELSE 0.0E0 END)")
PB = f"(0.5E0 * {PA} + 0.5E0 * (850.0E0 - fico_n) / 300.0E0)"
SCORED = f"""scored AS (
  SELECT id, split, "Default" AS label, {s(MODEL_A)} AS model, {PA} AS p FROM split
  UNION ALL
  SELECT id, split, "Default" AS label, {s(MODEL_B)} AS model, {PB} AS p FROM split)"""

CUM = """ties AS (SELECT model, split, p, COUNT(*) FILTER (WHERE label = 1) AS pos,
        COUNT(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY model, split, p),
cum AS (SELECT model, split, p, pos, neg,
  COALESCE(SUM(pos) OVER (PARTITION BY model, split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
  COALESCE(SUM(neg) OVER (PARTITION BY model, split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
  SUM(pos) OVER (PARTITION BY model, split) AS tot_pos, SUM(neg) OVER (PARTITION BY model, split) AS tot_neg
  FROM ties),
rankm AS (SELECT model, split,
  SUM(pos * (neg_below + neg * 0.5E0)) / (CAST(MAX(tot_pos) AS DOUBLE) * CAST(MAX(tot_neg) AS DOUBLE)) AS auc,
  GREATEST(MAX((tot_pos - pos_below) / CAST(tot_pos AS DOUBLE) - (tot_neg - neg_below) / CAST(tot_neg AS DOUBLE)), 0.0E0) AS ks
  FROM cum GROUP BY model, split),
thr AS (SELECT model, split,
  COUNT(*) FILTER (WHERE NOT (p > 0.5E0) AND NOT (label = 1)) AS tn,
  COUNT(*) FILTER (WHERE (p > 0.5E0) AND NOT (label = 1)) AS fp,
  COUNT(*) FILTER (WHERE NOT (p > 0.5E0) AND (label = 1)) AS fn,
  COUNT(*) FILTER (WHERE (p > 0.5E0) AND (label = 1)) AS tp
  FROM scored GROUP BY model, split),
thr2 AS (SELECT *,
  CASE WHEN tn + fp + fn + tp > 0 THEN (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE) ELSE 0.0E0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0E0 END AS "precision",
  CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0E0 END AS recall FROM thr),
thr3 AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2.0E0 * "precision" * recall / ("precision" + recall)
  ELSE 0.0E0 END AS f1 FROM thr2),
metrics AS (SELECT r.model, r.split, auc, 2.0E0 * auc - 1.0E0 AS gini, ks, tn, fp, fn, tp, accuracy, "precision",
  recall, f1 FROM rankm r JOIN thr3 t ON r.model = t.model AND r.split = t.split)"""


def _band(x: str, bands, other) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {num(c)} THEN {s(t)}" for c, t in bands) + f" ELSE {s(other)} END"


METRIC_NAMES = ["auc", "gini", "ks", "accuracy", "precision", "recall", "f1"]
COMP = ("comp_raw AS (SELECT model AS model_name, "
        + ", ".join(f"MAX(CASE WHEN split = '{sp}' THEN {q(m)} END) AS {sp}_{m}"
                    for sp in ("val", "test") for m in METRIC_NAMES)
        + ", " + ", ".join(f"MAX(CASE WHEN split = 'test' THEN {c} END) AS test_{c}" for c in ("tn", "fp", "fn", "tp"))
        + " FROM metrics GROUP BY model),\n"
        + "comp AS (SELECT model_name, "
        + ", ".join(f"{R6(f'{sp}_{m}')} AS {sp}_{m}" for sp in ("val", "test") for m in METRIC_NAMES)
        + ", test_tn, test_fp, test_fn, test_tp, "
        + _band("test_gini", K.GINI_BANDS, K.GINI_ELSE) + " AS gini_interpretation, "
        + _band("test_ks", K.KS_BANDS, K.KS_ELSE) + " AS ks_interpretation, "
        + f"CAST(CASE model_name WHEN {s(MODEL_A)} THEN 1 WHEN {s(MODEL_B)} THEN 2 END AS INTEGER) AS model_rank"
        + " FROM comp_raw)")

# ---- applications and decisions ----------------------------------------------------

APPS = """apps AS (SELECT id AS application_id, revenue,
  CASE WHEN id % 7 = 0 THEN 3.0E0 ELSE 1.0E0 END * loan_amnt AS loan_amnt,
  CAST(CASE WHEN id % 97 = 0 THEN 299 WHEN id % 89 = 0 THEN 851 ELSE fico_n - 40 END AS INTEGER) AS fico_n,
  dti_n / 80.0E0 AS dti_n,
  CAST(CASE WHEN id % 83 = 0 THEN 11 ELSE id % 11 END AS INTEGER) AS emp_length_numeric
FROM loans)"""


def _lim_txt(v) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def _field_error(field, lo, lo_inc, hi, hi_inc) -> str:
    pre = f"body -> {field}: "
    lo_bad = f"{field} < {lo}" if lo_inc else f"{field} <= {lo}"
    hi_bad = f"{field} > {hi}" if hi_inc else f"{field} >= {hi}"
    lo_msg = ("Input should be greater than or equal to " if lo_inc else "Input should be greater than ") + _lim_txt(lo)
    hi_msg = ("Input should be less than or equal to " if hi_inc else "Input should be less than ") + _lim_txt(hi)
    return (f"CASE WHEN {field} IS NULL THEN {s(pre + 'Field required')} WHEN {lo_bad} THEN {s(pre + lo_msg)} "
            f"WHEN {hi_bad} THEN {s(pre + hi_msg)} END")


def _field_ok(field) -> str:
    _, lo, lo_inc, hi, hi_inc = next(x for x in K.APPLICATION_LIMITS if x[0] == field)
    lo_ok = f"{field} >= {lo}" if lo_inc else f"{field} > {lo}"
    hi_ok = f"{field} <= {hi}" if hi_inc else f"{field} < {hi}"
    return f"COALESCE({field} IS NOT NULL AND {lo_ok} AND {hi_ok}, FALSE)"


_ERRS = []
for _f, _lo, _li, _hi, _hi_inc in K.APPLICATION_LIMITS:
    _ERRS.append(_field_error(_f, _lo, _li, _hi, _hi_inc))
    if _f == "loan_amnt":
        _ERRS.append(
            f"CASE WHEN {_field_ok('revenue')} AND {_field_ok('loan_amnt')} AND loan_amnt > revenue * 2.0E0 THEN "
            "'body -> loan_amnt: Value error, Loan amount ($' || format('{:,.0f}', loan_amnt) || "
            "') exceeds 2x annual income ($' || format('{:,.0f}', revenue) || ')' END")
ERR_LIST = ", ".join(_ERRS)
N_ERR = " + ".join(f"CASE WHEN ({e}) IS NULL THEN 0 ELSE 1 END" for e in _ERRS)

CHECKED = f"""checked AS (SELECT *, CAST({N_ERR} AS INTEGER) AS n_errors,
  concat_ws('|', {ERR_LIST}) AS errors, concat_ws('; ', {ERR_LIST}) AS details,
  COALESCE(CAST(dti_n > 0.8E0 AND dti_n <= 1.0E0 AS INTEGER), 0) AS high_dti_warning FROM apps),
valid AS (SELECT application_id, revenue, loan_amnt, fico_n, dti_n, emp_length_numeric FROM checked WHERE n_errors = 0)"""

_SERV = {
    "revenue": "CAST(revenue AS DOUBLE)",
    "loan_amnt": "CAST(loan_amnt AS DOUBLE)",
    "fico_n": "CAST(fico_n AS DOUBLE)",
    "dti_n": "dti_n * 100.0E0",
    "emp_length_numeric": "CAST(emp_length_numeric AS DOUBLE)",
    "loan_to_income": "CASE WHEN revenue = 0 THEN NULL ELSE loan_amnt / revenue END",
    "DTI_ratio": "CAST(dti_n AS DOUBLE)",
    "issue_year": "2025.0E0",
    "issue_month": "12.0E0",
    "issue_quarter": "4.0E0",
    "employment_stable": f"CAST({flag('emp_length_numeric >= 3')} AS DOUBLE)",
    "high_fico": f"CAST({flag('fico_n >= 700')} AS DOUBLE)",
    "is_homeowner": "0.0E0",
    "has_mortgage": "0.0E0",
    "is_renter": "1.0E0",
    "risky_loan_purpose": "0.0E0",
    "safe_loan_purpose": "1.0E0",
    "high_debt_low_income": f"CAST({flag('dti_n > 0.36E0 AND revenue < 50000.0E0')} AS DOUBLE)",
    "high_loan_low_fico": f"CAST({flag('loan_amnt > 20000.0E0 AND fico_n < 660')} AS DOUBLE)",
}
for _p in SERVING_PURPOSE_LEVELS[1:]:
    _SERV[f"purpose_{_p}"] = "1.0E0" if _p == "debt_consolidation" else "0.0E0"
for _h in ["OTHER", "OWN", "RENT"]:
    _SERV[f"home_ownership_n_{_h}"] = "1.0E0" if _h == "RENT" else "0.0E0"
_INC_L = left_closed("revenue", K.INCOME_EDGES, K.INCOME_LABELS)
for _b in K.INCOME_LABELS[1:]:
    _SERV[f"income_bracket_{_b}"] = f"CAST({flag(f'{_INC_L} = {s(_b)}')} AS DOUBLE)"
_FICO_L = left_closed("CAST(fico_n AS DOUBLE)", [670.0, 740.0, 800.0, float("inf")], ["Good", "Very Good", "Excellent"])
for _b in K.FICO_LABELS[1:]:
    _SERV[f"fico_bracket_{_b}"] = f"CAST({flag(f'{_FICO_L} = {s(_b)}')} AS DOUBLE)"

SERVING = ("serving AS (SELECT application_id, revenue AS raw_revenue, loan_amnt AS raw_loan_amnt, fico_n AS raw_fico_n, "
           "dti_n AS raw_dti_n, emp_length_numeric AS raw_emp_length_numeric, "
           + ", ".join(f"{e} AS {q(k)}" for k, e in _SERV.items()) + " FROM valid)")
SERVING_SCALED = ("serving_scaled AS (SELECT application_id, raw_revenue, raw_loan_amnt, raw_fico_n, raw_dti_n, "
                  "raw_emp_length_numeric, "
                  + ", ".join(f"{_scaled_expr(k)} AS {q(k)}" if k in K.NUMERIC_FEATURES else q(k) for k in _SERV)
                  + " FROM serving, sc)")


def _linear(coefs: dict, intercept: float) -> str:
    z = num(intercept)
    for name, w in coefs.items():
        z = f"{z} + {num(w)} * {q(name)}"
    return f"(1.0E0 / (1.0E0 + exp(-({z}))))"


PD_FULL = _linear(SC.COEFFICIENTS, SC.INTERCEPT)
PD_NUM = _linear(SC.NUMERIC_COEFFICIENTS, SC.NUMERIC_INTERCEPT)


def _risk(pd: str):
    cat = "CASE " + " ".join(f"WHEN {pd} < {num(c)} THEN {s(b)}" for c, b, _, _ in K.RISK_BANDS) + f" ELSE {s(K.RISK_ELSE[0])} END"
    conf = "CASE " + " ".join(f"WHEN {pd} < {num(c)} THEN {num(v)}" for c, _, v, _ in K.RISK_BANDS) + f" ELSE {num(K.RISK_ELSE[1])} END"
    rec = "CASE " + " ".join(f"WHEN {pd} < {num(c)} THEN {s(r)}" for c, _, _, r in K.RISK_BANDS) + f" ELSE {s(K.RISK_ELSE[2])} END"
    return cat, conf, rec


def _factors(p: str = "") -> list[str]:
    rev, loan, fico, dti, emp = (f"{p}{c}" for c in ["revenue", "loan_amnt", "fico_n", "dti_n", "emp_length_numeric"])
    lti = f"(CASE WHEN {rev} > 0 THEN {loan} / {rev} ELSE CAST('inf' AS DOUBLE) END)"
    return [
        f"CASE WHEN {fico} < 620 THEN {s(K.FACTOR_FICO_VERY_LOW)} WHEN {fico} < 680 THEN {s(K.FACTOR_FICO_BELOW_AVG)} END",
        f"CASE WHEN {dti} > 0.45E0 THEN {s(K.FACTOR_DTI_HIGH)} WHEN {dti} > 0.35E0 THEN {s(K.FACTOR_DTI_ELEVATED)} END",
        f"CASE WHEN {lti} > 0.5E0 THEN {s(K.FACTOR_LTI_LARGE)} WHEN {lti} > 0.35E0 THEN {s(K.FACTOR_LTI_MODERATE)} END",
        f"CASE WHEN {emp} < 2 THEN {s(K.FACTOR_EMP_SHORT)} END",
        f"CASE WHEN {rev} < 30000 THEN {s(K.FACTOR_LOW_INCOME)} END",
    ]


def _basic_factors() -> list[str]:
    return [
        f"CASE WHEN dti_n > 0.4E0 THEN {s(K.BASIC_FACTOR_DTI)} END",
        f"CASE WHEN fico_n < 650 THEN {s(K.BASIC_FACTOR_FICO)} END",
        f"CASE WHEN loan_amnt > revenue * 0.5E0 THEN {s(K.BASIC_FACTOR_LTI)} END",
        f"CASE WHEN emp_length_numeric < 2 THEN {s(K.BASIC_FACTOR_EMP)} END",
    ]


def _count_non_null(exprs) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN ({e}) IS NULL THEN 0 ELSE 1 END" for e in exprs) + " AS INTEGER)"


# ---- chain ------------------------------------------------------------------------------

CHAIN = [LOANS, CLEANED, WB, WINSORIZED, CLEAN_FINAL, FQ, F1, FEAT, SELECTED, ENCODED, SC_STATS, SCALED,
         SPLIT, SCORED, CUM, COMP, APPS, CHECKED, SERVING, SERVING_SCALED]


def W(body: str) -> str:
    return "WITH " + ",\n".join(CHAIN) + "\n" + body


def _round_select(cols, types, src) -> str:
    return ", ".join(R6(q(c)) + f" AS {q(c)}" if types.get(c) == "double" else q(c) for c in cols) + f" FROM {src}"


_LOAN_TYPES = {"revenue": "double", "dti_n": "double", "fico_n": "double"}
_WIN_TYPES = {c: "double" for c in WINSOR_COLS}


def _unpivot(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


def _sql() -> dict[str, str]:
    o: dict[str, str] = {}
    na = "(" + ", ".join(s(t) for t in NA_TOKENS) + ")"
    o["scan_loans"] = W("SELECT " + ", ".join(
        f"CASE WHEN {q(c)} IN {na} THEN NULL ELSE {q(c)} END AS {q(c)}" if c in TEXT_COLS else q(c)
        for c in LOAN_COLUMNS) + " FROM loans")
    o["roundtrip_loans"] = W("SELECT * FROM loans")

    ncols = len(LOAN_COLUMNS)
    missing_sum = " + ".join(f"COUNT(*) - COUNT({q(c)})" for c in LOAN_COLUMNS)
    with_missing = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN COUNT(*) - COUNT({q(c)}) > 0 THEN {s(c)} END" for c in LOAN_COLUMNS) + ")"
    profile = (f"prof AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST({missing_sum} AS BIGINT) AS total_missing, "
               f"{with_missing} AS columns_with_missing, "
               f"CAST(COUNT(*) FILTER (WHERE \"Default\" = 1) AS BIGINT) AS n_default, AVG(\"Default\") AS rate, "
               + ", ".join(f"COUNT({q(c)}) AS nn_{i}" for i, c in enumerate(LOAN_COLUMNS)) + " FROM loans), "
               "dup AS (SELECT CAST((SELECT COUNT(*) FROM loans) - COUNT(*) AS BIGINT) AS duplicate_rows, "
               "CAST(COUNT(*) AS BIGINT) AS distinct_rows FROM (SELECT DISTINCT * FROM loans) d)")
    n_num = sum(1 for c in LOAN_COLUMNS if c in DTYPE)
    o["quality_profile"] = ("WITH " + ",\n".join(CHAIN) + ",\n" + profile + "\n"
                            f"SELECT n_rows AS rows, CAST({ncols} AS BIGINT) AS columns, duplicate_rows, "
                            f"CAST({n_num} AS BIGINT) AS numeric_columns, CAST({ncols - n_num} AS BIGINT) AS object_columns, "
                            "CAST(0 AS BIGINT) AS datetime_columns, CAST(0 AS BIGINT) AS categorical_columns, "
                            f"total_missing, {R6(f'total_missing / CAST(n_rows * {ncols} AS DOUBLE) * 100')} AS missing_pct, "
                            "columns_with_missing FROM prof, dup")
    o["dataset_metadata"] = ("WITH " + ",\n".join(CHAIN) + ",\n" + profile + "\n"
                             f"SELECT n_rows AS rows, CAST({ncols} AS BIGINT) AS columns, duplicate_rows, total_missing, "
                             f"{R6(f'total_missing / CAST(n_rows * {ncols} AS DOUBLE) * 100')} AS missing_pct, "
                             f"columns_with_missing, n_default, {R6('rate')} AS default_rate, "
                             "'Default' AS target_column FROM prof, dup")
    o["duplicate_rows"] = ("WITH " + ",\n".join(CHAIN) + ",\n" + profile + "\nSELECT duplicate_rows, distinct_rows FROM dup")
    all_null = "concat_ws(', ', " + ", ".join(f"CASE WHEN nn_{i} = 0 THEN {s(c)} END" for i, c in enumerate(LOAN_COLUMNS)) + ")"
    n_all_null = " + ".join(f"CASE WHEN nn_{i} = 0 THEN 1 ELSE 0 END" for i in range(ncols))
    checks = [
        ("row_count", "CAST(n_rows AS DOUBLE)", "1000000.0E0", "1500000.0E0",
         "n_rows >= 1000000 AND n_rows <= 1500000",
         "format('Row count {:,} outside expected range [1,000,000, 1,500,000]', n_rows)"),
        ("column_count", f"{float(ncols)}E0", "10.0E0", "20.0E0", "TRUE" if 10 <= ncols <= 20 else "FALSE",
         s(f"Column count {ncols} outside expected range [10, 20]")),
        ("target_present", "1.0E0", "1.0E0", "1.0E0", "TRUE", s("Target column 'Default' not found")),
        ("non_empty", "CAST(n_rows AS DOUBLE)", "1.0E0", "CAST(NULL AS DOUBLE)", "n_rows > 0",
         s("DataFrame is completely empty")),
        ("all_null_columns", f"CAST({n_all_null} AS DOUBLE)", "0.0E0", "0.0E0", f"({n_all_null}) = 0",
         f"'Columns with all null values: [' || {all_null} || ']'"),
        ("duplicate_rows", "CAST(duplicate_rows AS DOUBLE)", "0.0E0", "n_rows * 0.01E0",
         "duplicate_rows <= n_rows * 0.01E0",
         "format('High duplicate count: {:,} rows ({:.2f}%)', duplicate_rows, duplicate_rows / n_rows * 100)"),
    ]
    rows = [f"SELECT {s(n)} AS \"check\", {obs} AS observed, {lo} AS lo, {hi} AS hi, CAST({ok} AS INTEGER) AS ok, "
            f"CASE WHEN NOT ({ok}) THEN {err} END AS error FROM prof, dup" for n, obs, lo, hi, ok, err in checks]
    all_ok = " AND ".join(f"({c[4]})" for c in checks)
    rows.append(f"SELECT 'is_valid', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
                f"CAST({all_ok} AS INTEGER), CAST(NULL AS VARCHAR) FROM prof, dup")
    o["validate_structure"] = "WITH " + ",\n".join(CHAIN) + ",\n" + profile + "\n" + _unpivot(rows)

    o["target_distribution"] = W(
        "SELECT \"Default\" AS label, CAST(COUNT(*) AS BIGINT) AS n, "
        f"{R6('COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)')} AS share, "
        f"{R6('SUM(\"Default\" * COUNT(*)) OVER () / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)')} AS default_rate "
        "FROM loans WHERE \"Default\" IS NOT NULL GROUP BY \"Default\"")
    o["column_non_null"] = W(_unpivot([
        f"SELECT {s(c)} AS column_name, CAST({i} AS INTEGER) AS position, {s(DTYPE.get(c, 'object'))} AS dtype, "
        f"CAST(COUNT({q(c)}) AS BIGINT) AS non_null FROM loans" for i, c in enumerate(LOAN_COLUMNS)]))

    miss_rows = []
    for c in LOAN_COLUMNS:
        small = "'fill_unknown'" if c in TEXT_COLS else "'drop_rows'"
        pct = f"(COUNT(*) - COUNT({q(c)})) / CAST(COUNT(*) AS DOUBLE) * 100"
        miss_rows.append(f"SELECT {s(c)} AS column_name, CAST(COUNT(*) - COUNT({q(c)}) AS BIGINT) AS missing_count, "
                         f"{R6(pct)} AS missing_pct, CASE WHEN {pct} > 50 THEN 'drop_column' WHEN {pct} < 5 THEN {small} "
                         f"ELSE 'none' END AS action FROM loans")
    o["missing_report"] = W("SELECT * FROM (" + _unpivot(miss_rows) + ") m WHERE missing_count > 0")
    o["clean_missing"] = W("SELECT " + _round_select(CLEAN_COLS, _LOAN_TYPES, "cleaned"))
    o["low_cardinality"] = W(_unpivot([
        f"SELECT {s(c)} AS column_name, CAST(COUNT(DISTINCT {q(c)}) AS BIGINT) AS n_distinct, "
        f"CAST(COUNT(DISTINCT {q(c)}) < 50 AS INTEGER) AS low_cardinality FROM cleaned" for c in CLEAN_TEXT]))

    iqr_rows = []
    for c in WINSOR_COLS:
        lo = f"(quantile_cont({c}, 0.25) - 1.5E0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)))"
        hi = f"(quantile_cont({c}, 0.75) + 1.5E0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)))"
        iqr_rows.append(f"SELECT {s(c)} AS column_name, {lo} AS lb, {hi} AS ub FROM cleaned")
    o["iqr_outliers"] = W(
        "SELECT column_name, outliers, " + R6("pct") + " AS pct, " + R6("lb") + " AS lower_bound, "
        + R6("ub") + " AS upper_bound FROM (SELECT b.column_name, b.lb, b.ub, "
        "CAST(COUNT(*) FILTER (WHERE v.x < b.lb OR v.x > b.ub) AS BIGINT) AS outliers, "
        "COUNT(*) FILTER (WHERE v.x < b.lb OR v.x > b.ub) / CAST((SELECT COUNT(*) FROM cleaned) AS DOUBLE) * 100 AS pct "
        "FROM (" + _unpivot(iqr_rows) + ") b JOIN (" + _unpivot(
            [f"SELECT {s(c)} AS column_name, CAST({c} AS DOUBLE) AS x FROM cleaned" for c in WINSOR_COLS])
        + ") v ON b.column_name = v.column_name GROUP BY b.column_name, b.lb, b.ub) t "
        "WHERE outliers > 0 ORDER BY pct DESC, column_name LIMIT 10")
    o["winsorize"] = W("SELECT " + _round_select(CLEAN_COLS, _WIN_TYPES, "winsorized"))
    o["class_balance"] = W(
        "SELECT \"Default\" AS label, CAST(COUNT(*) AS BIGINT) AS n, "
        f"{R6('COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) * 100')} AS pct, "
        f"{R6('MAX(CASE WHEN \"Default\" = 0 THEN COUNT(*) END) OVER () / CAST(MAX(CASE WHEN \"Default\" = 1 THEN COUNT(*) END) OVER () AS DOUBLE)')} AS imbalance_ratio "
        "FROM winsorized WHERE \"Default\" IS NOT NULL GROUP BY \"Default\"")
    stat_rows = []
    for c in NUMERIC_LOAN_COLS:
        x = f"CAST({q(c)} AS DOUBLE)"
        stat_rows.append(
            f"SELECT {s(c)} AS column_name, CAST(COUNT({x}) AS BIGINT) AS count, {R6(f'AVG({x})')} AS mean, "
            f"{R6(f'STDDEV_SAMP({x})')} AS std, {R6(f'MIN({x})')} AS min, {R6(f'quantile_cont({x}, 0.25)')} AS p25, "
            f"{R6(f'quantile_cont({x}, 0.5)')} AS p50, {R6(f'quantile_cont({x}, 0.75)')} AS p75, "
            f"{R6(f'MAX({x})')} AS max, {R6(f'COALESCE(skewness({x}), 0.0E0)')} AS skewness, "
            f"{R6(f'COALESCE(kurtosis({x}), 0.0E0)')} AS kurtosis FROM winsorized")
    o["statistical_summary"] = W(_unpivot(stat_rows))
    o["top_std"] = W("SELECT column_name, mean, std, min, max FROM (" + _unpivot(stat_rows)
                     + ") t ORDER BY std DESC, column_name LIMIT 5")
    o["clean_final"] = W("SELECT " + _round_select(CLEAN_COLS, _WIN_TYPES, "clean_final"))

    o["financial_ratios"] = W(f"SELECT id, {R6('DTI_ratio')} AS DTI_ratio, {R6('loan_to_income')} AS loan_to_income FROM feat")
    o["income_bracket"] = W(f"SELECT id, {R6('revenue')} AS revenue, income_bracket FROM feat")
    o["temporal_features"] = W("SELECT id, issue_d, issue_year, issue_month, issue_quarter FROM feat")
    o["employment_features"] = W("SELECT id, emp_length, emp_length_numeric, employment_stable FROM feat")
    o["credit_score_features"] = W(f"SELECT id, {R6('fico_n')} AS fico_n, fico_bracket, high_fico FROM feat")
    o["purpose_features"] = W("SELECT purpose, risky_loan_purpose, safe_loan_purpose, CAST(COUNT(*) AS BIGINT) AS n_loans "
                              "FROM feat GROUP BY purpose, risky_loan_purpose, safe_loan_purpose")
    o["home_ownership_features"] = W("SELECT id, home_ownership_n, is_homeowner, has_mortgage, is_renter FROM feat")
    o["interaction_features"] = W("SELECT id, high_debt_low_income, high_loan_low_fico FROM feat")
    sel_types = {c: "double" for c in ["revenue", "loan_amnt", "fico_n", "dti_n", "loan_to_income", "DTI_ratio"]}
    o["select_features"] = W("SELECT " + _round_select(SELECTED_COLS, sel_types, "selected"))
    o["one_hot"] = W("SELECT " + _round_select(ENC_COLS, sel_types, "encoded"))
    o["standard_scale"] = W("SELECT " + _round_select(ENC_COLS, {c: "double" for c in K.NUMERIC_FEATURES}, "scaled"))
    k = len(K.NUMERIC_FEATURES)
    mm = " + ".join(f"AVG({q(c)})" for c in K.NUMERIC_FEATURES)
    ms = " + ".join(f"STDDEV_SAMP({q(c)})" for c in K.NUMERIC_FEATURES)
    o["scale_check"] = W(f"SELECT {k} AS n_scaled, {R6(f'({mm}) / {k}.0E0')} AS mean_of_means, "
                         f"{R6(f'({ms}) / {k}.0E0')} AS mean_of_stds FROM scaled")
    manifest = [c for c in ENC_COLS if c != "id"]

    def grp(c):
        if c == "Default":
            return "target"
        if c in K.NUMERIC_FEATURES:
            return "numeric"
        if c in K.BINARY_FEATURES:
            return "binary"
        return "categorical_dummy"
    o["feature_manifest"] = W(_unpivot([
        f"SELECT CAST({i} AS INTEGER) AS position, {s(c)} AS feature, {s(grp(c))} AS feature_group, "
        f"CAST({len(manifest) - 1} AS INTEGER) AS n_features, CAST(COUNT(*) AS BIGINT) AS n_samples FROM scaled"
        for i, c in enumerate(manifest)]))

    o["stratified_split"] = W("SELECT id, \"Default\", split FROM split")
    o["stratified_split_boundary"] = o["stratified_split"]
    o["split_summary"] = W("SELECT split, CAST(COUNT(*) AS BIGINT) AS n, "
                           f"{R6('COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)')} AS share, "
                           f"{R6('AVG(\"Default\")')} AS default_rate FROM split GROUP BY split")
    o["class_weights"] = W("SELECT \"Default\" AS label, CAST(COUNT(*) AS BIGINT) AS n_class, "
                           f"{R6('SUM(COUNT(*)) OVER () / CAST(COUNT(*) OVER () * COUNT(*) AS DOUBLE)')} AS weight "
                           "FROM split WHERE split = 'train' GROUP BY \"Default\"")
    o["scale_pos_weight"] = W("SELECT n_negative, n_positive, "
                              f"{R6('n_negative / CAST(n_positive AS DOUBLE)')} AS scale_pos_weight FROM ("
                              "SELECT CAST(COUNT(*) FILTER (WHERE \"Default\" = 0) AS BIGINT) AS n_negative, "
                              "CAST(COUNT(*) FILTER (WHERE \"Default\" = 1) AS BIGINT) AS n_positive "
                              "FROM split WHERE split = 'train') t")

    o["auc_roc"] = W(f"SELECT model, split, {R6('auc')} AS auc FROM metrics")
    o["auc_roc_buckets"] = o["auc_roc"]
    o["gini"] = W(f"SELECT model, split, {R6('gini')} AS gini FROM metrics")
    o["ks_statistic"] = W(f"SELECT model, split, {R6('ks')} AS ks FROM metrics")
    o["roc_curve"] = W(f"SELECT model, split, {R6('p')} AS threshold, "
                       f"{R6('(tot_neg - neg_below) / CAST(tot_neg AS DOUBLE)')} AS fpr, "
                       f"{R6('(tot_pos - pos_below) / CAST(tot_pos AS DOUBLE)')} AS tpr FROM cum")
    o["classification_metrics"] = W("SELECT model, split, " + ", ".join(
        f"{R6(q(c))} AS {q(c)}" for c in ("accuracy", "precision", "recall", "f1")) + " FROM metrics")
    o["confusion_matrix"] = W("SELECT model, split, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, "
                              "CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM metrics")
    o["metric_bands"] = W(f"SELECT model, split, {R6('gini')} AS gini, {_band('gini', K.GINI_BANDS, K.GINI_ELSE)} AS gini_band, "
                          f"{R6('ks')} AS ks, {_band('ks', K.KS_BANDS, K.KS_ELSE)} AS ks_band FROM metrics")
    o["model_comparison"] = W("SELECT * FROM comp")
    o["best_model"] = W("SELECT (SELECT model_name FROM comp ORDER BY test_auc DESC, model_rank LIMIT 1) AS best_model, "
                        "MAX(test_auc) AS best_auc, MAX(test_gini) AS best_gini, MAX(test_ks) AS best_ks FROM comp")
    o["leaderboard"] = W("SELECT model_name, test_auc, test_gini, test_ks, test_f1, "
                         "CAST(model_name = (SELECT model_name FROM comp ORDER BY test_auc DESC, model_rank LIMIT 1) "
                         "AS INTEGER) AS is_best FROM comp")
    o["model_info"] = W("SELECT model_name, test_auc, test_gini, test_ks, "
                        f"CAST({len(manifest) - 1} AS INTEGER) AS features_count, "
                        f"CAST({len(manifest)} AS INTEGER) AS all_features_count, "
                        "(SELECT CAST(COUNT(*) AS BIGINT) FROM scaled) AS n_samples FROM comp "
                        "WHERE model_name = (SELECT model_name FROM comp ORDER BY test_auc DESC, model_rank LIMIT 1)")

    o["validate_applications"] = W("SELECT application_id, n_errors, errors, high_dti_warning, "
                                   "CAST(n_errors = 0 AS INTEGER) AS is_valid FROM checked")
    o["rejected_applications"] = W("SELECT application_id, n_errors, details FROM checked WHERE n_errors > 0")
    o["serving_features"] = W("SELECT application_id, " + ", ".join(f"{R6(q(k))} AS {q(k)}" for k in _SERV) + " FROM serving")
    o["score_applications"] = W(f"SELECT application_id, {R6(PD_FULL)} AS pd FROM serving_scaled")
    cat, conf, rec = _risk("pd")
    o["risk_category"] = W(f"SELECT application_id, {R6('pd')} AS pd, {cat} AS risk_category, {conf} AS confidence_score, "
                           f"{rec} AS recommendation FROM (SELECT application_id, {PD_FULL} AS pd FROM serving_scaled) t")
    fac = _factors()
    o["risk_factors"] = W(f"SELECT application_id, {_count_non_null(fac)} AS n_factors, "
                          f"CASE WHEN {_count_non_null(fac)} = 0 THEN {s(K.NO_FACTORS)} "
                          f"ELSE concat_ws('|', {', '.join(fac)}) END AS risk_factors FROM valid")
    bfac = _basic_factors()
    o["risk_factors_basic"] = W(f"SELECT application_id, {_count_non_null(bfac)} AS n_factors, "
                                f"concat_ws('|', {', '.join(bfac)}) AS risk_factors FROM valid")
    rfac = _factors("raw_")
    o["decisions"] = W(
        f"SELECT application_id, round_even(pd, 4) AS probability_of_default, "
        f"printf('%.2f%%', pd * 100) AS probability_percentage, {cat} AS risk_category, {conf} AS confidence_score, "
        f"{rec} AS recommendation, CASE WHEN {_count_non_null(rfac)} = 0 THEN {s(K.NO_FACTORS)} "
        f"ELSE concat_ws('|', {', '.join(rfac)}) END AS risk_factors "
        f"FROM (SELECT *, {PD_FULL} AS pd FROM serving_scaled) t")
    # the stream decides exactly the batch's applications: same statement
    o["stream_decisions"] = o["decisions"]
    o["stream_decisions_repeated"] = o["decisions"]
    cat_n, _, _ = _risk("pd")
    o["score_numeric_only"] = W(f"SELECT application_id, {R6('pd')} AS pd, {cat_n} AS risk_category "
                                f"FROM (SELECT application_id, {PD_NUM} AS pd FROM serving_scaled) t")

    means = "bg AS (SELECT " + ", ".join(f"AVG(CAST({q(c)} AS DOUBLE)) AS {q('m_' + c)}" for c in SC.COEFFICIENTS) + " FROM scaled)"
    contrib = [f"SELECT id, {s(c)} AS feature, {num(w)} * (CAST({q(c)} AS DOUBLE) - {q('m_' + c)}) AS contribution FROM scaled, bg"
               for c, w in SC.COEFFICIENTS.items()]
    o["linear_attribution"] = ("WITH " + ",\n".join(CHAIN) + ",\n" + means + "\nSELECT id, feature, "
                               + R6("contribution") + " AS contribution FROM (" + _unpivot(contrib) + ") t")
    imp = [f"SELECT {s(c)} AS feature, AVG(ABS({num(w)} * (CAST({q(c)} AS DOUBLE) - {q('m_' + c)}))) AS importance "
           "FROM scaled, bg" for c, w in SC.COEFFICIENTS.items()]
    o["feature_importance"] = ("WITH " + ",\n".join(CHAIN) + ",\n" + means + "\nSELECT feature, " + R6("importance")
                               + " AS importance FROM (" + _unpivot(imp) + ") t ORDER BY importance DESC, feature")
    o["feature_importance_top"] = o["feature_importance"] + " LIMIT 10"
    o["linear_attribution_wide"] = ("WITH " + ",\n".join(CHAIN) + ",\n" + means + "\nSELECT id, " + ", ".join(
        R6(f"{num(w)} * (CAST({q(c)} AS DOUBLE) - {q('m_' + c)})") + f" AS {q('contribution_' + c)}"
        for c, w in SC.COEFFICIENTS.items()) + " FROM scaled, bg")
    o["tail_sample"] = W('SELECT id, "Default" FROM scaled ORDER BY id DESC LIMIT 1000')

    # fitted models: what must hold for any right fit, from the tables
    feats = [c for c in manifest if c != "Default"]
    o["feature_target"] = W('SELECT id, CAST("Default" AS DOUBLE) AS label, ' + f"CAST({len(feats)} AS INTEGER) AS n_features, "
                            "ROUND(" + " + ".join(f"CAST({q(c)} AS DOUBLE)" for c in feats) + ", 4) + 0.0E0 AS feature_sum FROM scaled")
    fold = ('folds AS (SELECT id, "Default", CAST((ROW_NUMBER() OVER (PARTITION BY "Default" ORDER BY '
            "md5(CAST(id AS VARCHAR) || '|" + str(K.RANDOM_STATE) + "'), id) - 1) % 3 AS INTEGER) AS fold FROM split WHERE split = 'train')")
    o["stratified_folds"] = "WITH " + ",\n".join([*CHAIN, fold]) + '\nSELECT id, "Default", fold FROM folds'
    # the fitted models' split covers the engineered rows
    chain = [c.replace("FROM loans", "FROM clean_final") if c is SPLIT else c for c in CHAIN]
    train = "fit AS (SELECT COUNT(*) FILTER (WHERE split = 'train') AS n_train, COUNT(*) FILTER (WHERE split = 'val') AS n_val, " \
            "COUNT(*) FILTER (WHERE split = 'train' AND \"Default\" = 0) AS neg, " \
            "COUNT(*) FILTER (WHERE split = 'train' AND \"Default\" = 1) AS pos FROM split)"
    o["training_runs"] = "WITH " + ",\n".join([*chain, train]) + "\n" + _unpivot([
        f"SELECT {s(m)} AS model_name, CAST(n_train AS BIGINT) AS n_train, CAST(n_val AS BIGINT) AS n_val, "
        f"CAST({len(feats)} AS INTEGER) AS n_features, CAST({rounds} AS INTEGER) AS max_iter, "
        f"{reg} AS reg_param, {spw} AS scale_pos_weight FROM fit"
        for m, rounds, reg, spw in ((MODEL_A, 1000, "ROUND(1.0E0 / n_train, 9) + 0.0E0", "CAST(NULL AS DOUBLE)"),
                                    (MODEL_B, 200, "CAST(NULL AS DOUBLE)", R6("neg / CAST(pos AS DOUBLE)")))])
    o["train_lr_optimum"] = "WITH " + ",\n".join(chain) + "\n" + _unpivot(
        [f"SELECT {s(f)} AS feature, CAST(COUNT({c}) > 0 AS INTEGER) AS at_optimum FROM scaled"
         for f, c in [*((f, q(f)) for f in feats), ("(intercept)", "*")]])
    o["evaluate_trained_counts"] = "WITH " + ",\n".join(chain) + "\n" + _unpivot([
        f"SELECT {s(m)} AS model, split, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(\"Default\") AS BIGINT) AS n_positive, "
        "CAST(1 AS INTEGER) AS gini_agrees, CAST(1 AS INTEGER) AS better_than_chance FROM split WHERE split <> 'train' GROUP BY split"
        for m in (MODEL_A, MODEL_B)])
    o["tune_lr_optimum"] = "WITH " + ",\n".join([*chain, fold]) + (
        "\nSELECT CAST(c AS DOUBLE) AS C, CAST(f AS INTEGER) AS fold, (SELECT COUNT(*) FROM folds WHERE fold <> f) AS n_train, "
        f"CAST(1 AS INTEGER) AS at_optimum FROM (SELECT UNNEST({K.LR_GRID_C}) AS c) a, (SELECT UNNEST([0, 1, 2]) AS f) b")
    o["scan_loans_counts"] = W(
        "SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE id % 50 <> 0 AND id % 70 <> 0) AS good_rows, COUNT(*) FILTER (WHERE id % 50 = 0 OR id % 70 = 0) AS rejected_rows, "
        "COUNT(*) FILTER (WHERE id % 70 = 0) AS wrong_fields, COUNT(*) FILTER (WHERE id % 50 = 0 AND id % 70 <> 0) AS unparsed_numbers, "
        "COUNT(*) FILTER (WHERE id % 90 = 0 AND id % 50 <> 0 AND id % 70 <> 0) AS unparsed_dates FROM loans")
    types = {"bigint": ("id", "loan_amnt", "experience_c", "Default"), "double": ("revenue", "dti_n", "fico_n")}
    kind = {c: t for t, cs in types.items() for c in cs}
    o["column_metadata"] = W(_unpivot([f"SELECT CAST({i + 1} AS INTEGER) AS position, {s(c)} AS column_name, {s(kind.get(c, 'string'))} AS dtype, "
                                       f"COUNT({q(c)}) AS non_null, COUNT(*) - COUNT({q(c)}) AS missing FROM loans" for i, c in enumerate(LOAN_COLUMNS)]))
    o["profile_incremental"] = W(_unpivot([f"SELECT {s(c)} AS column_name, COUNT(*) AS rows, COUNT({q(c)}) AS non_null, "
                                           "COUNT(*) FILTER (WHERE \"Default\" = 1) AS positives FROM loans" for c in LOAN_COLUMNS]))
    o["split_record"] = W(f"SELECT split, CAST(COUNT(*) AS BIGINT) AS n, {R6('AVG(CAST(\"Default\" AS DOUBLE))')} AS default_rate, CAST({K.RANDOM_STATE} AS INTEGER) AS seed, "
                          f"{num(K.TEST_SIZE)} AS test_size, {num(K.VAL_SIZE)} AS val_size FROM split GROUP BY split")
    o["engineered_by_year"] = "WITH " + ",\n".join(chain) + (
        f"\nSELECT s.id, s.\"Default\", CAST(YEAR(CAST(c.issue_d AS DATE)) AS INTEGER) AS loan_year, {R6('s.loan_amnt')} AS loan_amnt FROM scaled s JOIN clean_final c ON s.id = c.id "
        "WHERE YEAR(CAST(c.issue_d AS DATE)) >= (SELECT MAX(YEAR(CAST(issue_d AS DATE))) - 1 FROM clean_final)")
    both = _unpivot([f"SELECT application_id, {s(m)} AS model FROM valid" for m in (MODEL_A, MODEL_B)])
    o["decisions_trained_checked"] = W("SELECT application_id, model, CAST(1 AS INTEGER) AS is_probability, CAST(1 AS INTEGER) AS band_agrees, "
                                       f"CAST(1 AS INTEGER) AS decided FROM ({both}) t")
    long = _unpivot([f"SELECT {s(f)} AS feature, CAST({q(f)} AS DOUBLE) AS x, \"Default\" AS y FROM part" for f in feats])
    o["gbt_root_split"] = "WITH " + ",\n".join([
        *chain, "part AS (SELECT s.* FROM scaled s JOIN split p ON s.id = p.id WHERE p.split = 'train')", f"long AS ({long})",
        "ends AS (SELECT feature, MIN(x) AS lo, MAX(x) AS hi, COUNT(DISTINCT x) AS kinds FROM long GROUP BY feature)",
        f"cuts AS (SELECT feature, UNNEST(quantile_cont(x, {[i / 16 for i in range(1, 16)]})) AS e FROM long GROUP BY feature)",
        "edges AS (SELECT feature, lo AS e FROM ends WHERE lo < hi UNION SELECT c.feature, c.e FROM cuts c JOIN ends n ON c.feature = n.feature WHERE c.e < hi AND kinds > 2)",
        "whole AS (SELECT COUNT(*) FILTER (WHERE \"Default\" = 0) AS neg, COUNT(*) FILTER (WHERE \"Default\" = 1) AS pos FROM part)",
        "sides AS (SELECT l.feature, e, COUNT(*) FILTER (WHERE x <= e AND y = 0) AS n0, COUNT(*) FILTER (WHERE x <= e AND y = 1) AS n1 "
        "FROM long l JOIN edges d ON l.feature = d.feature GROUP BY l.feature, e)",
        # at margin 0 a negative row has g = 0.5 and h = 0.25, a positive one -0.5 and 0.25 times the class weight
        "sums AS (SELECT feature, e, n0 + n1 AS n_left, neg + pos - n0 - n1 AS n_right, 0.5E0 * n0 - 0.5E0 * neg / pos * n1 AS gl, 0.25E0 * n0 + 0.25E0 * neg / pos * n1 AS hl, "
        "0.5E0 * (neg - n0) - 0.5E0 * neg / pos * (pos - n1) AS gr, 0.25E0 * (neg - n0) + 0.25E0 * neg / pos * (pos - n1) AS hr FROM sides, whole)",
        "gains AS (SELECT *, ROUND(gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1), 6) AS gain FROM sums WHERE hl >= 1 AND hr >= 1)",
        "best AS (SELECT * FROM gains WHERE gain > 1E-6 QUALIFY ROW_NUMBER() OVER (PARTITION BY feature ORDER BY gain DESC, e) = 1)"]) + (
        f"\nSELECT feature, {R6('e')} AS threshold, ROUND(gain, 3) AS gain, n_left, n_right, ROUND(gl, 4) + 0.0E0 AS g_left, ROUND(hl, 4) AS h_left, "
        "ROUND(-gl / (hl + 1), 4) + 0.0E0 AS left_value, ROUND(-gr / (hr + 1), 4) + 0.0E0 AS right_value FROM best")
    o["tree_attribution_additive"] = "WITH " + ",\n".join(chain) + "\nSELECT id, CAST(1 AS INTEGER) AS additive FROM split"
    return o


ORACLES = _sql()
