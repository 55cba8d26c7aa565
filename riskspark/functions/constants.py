"""Fixed values that results depend on, stated once, in natural order.

Everything here must equal the studied pipeline's values for results to
match: bin edges and labels, text maps, level sets, thresholds and texts.
"""

# ---- fixed values: feature engineering ------------------------------------

# Income brackets: right-closed bins (0,25000], (25000,50000], ... (100000, inf).
INCOME_EDGES = [0.0, 25000.0, 50000.0, 75000.0, 100000.0, float("inf")]
INCOME_LABELS = ["<25K", "25K-50K", "50K-75K", "75K-100K", ">100K"]

# FICO brackets: right-closed bins (0,580], (580,670], (670,740], (740,800], (800,900].
FICO_EDGES = [0.0, 580.0, 670.0, 740.0, 800.0, 900.0]
FICO_LABELS = ["Poor", "Fair", "Good", "Very Good", "Excellent"]

# Employment length text -> years; anything else (and missing) -> 0.
EMP_LENGTH_YEARS = {
    "< 1 year": 0,
    "1 year": 1,
    "2 years": 2,
    "3 years": 3,
    "4 years": 4,
    "5 years": 5,
    "6 years": 6,
    "7 years": 7,
    "8 years": 8,
    "9 years": 9,
    "10+ years": 10,
    "n/a": 0,
    "Unknown": 0,
}
EMPLOYMENT_STABLE_YEARS = 3
HIGH_FICO_TRAINING = 740
RISKY_PURPOSES = ["other", "wedding", "vacation", "small_business"]
SAFE_PURPOSES = ["debt_consolidation", "home_improvement", "medical"]
LOW_INCOME_BRACKETS = ["<25K", "25K-50K"]
LOAN_TO_INCOME_CAP = 10.0

NUMERIC_FEATURES = [
    "revenue", "loan_amnt", "fico_n", "dti_n", "emp_length_numeric",
    "loan_to_income", "DTI_ratio", "issue_year", "issue_month", "issue_quarter",
]
BINARY_FEATURES = [
    "employment_stable", "high_fico", "is_homeowner", "has_mortgage", "is_renter",
    "risky_loan_purpose", "safe_loan_purpose", "high_debt_low_income", "high_loan_low_fico",
]
CATEGORICAL_FEATURES = ["purpose", "home_ownership_n", "income_bracket", "fico_bracket"]
TARGET = "Default"
KEY = "id"

# ---- fixed values: cleaning and profiling -----------------------------------

DROP_COLUMN_MISSING_PCT = 50.0      # drop a column when strictly above
ACT_ON_MISSING_PCT = 5.0            # act on a column when 0 < pct < 5
TEXT_FILL = "Unknown"
LOW_CARDINALITY_MAX = 50            # strictly fewer distinct values
IQR_FACTOR = 1.5
WINSOR_LOW, WINSOR_HIGH = 0.01, 0.99
ROWS_MIN, ROWS_MAX = 1_000_000, 1_500_000
COLUMNS_MIN, COLUMNS_MAX = 10, 20
DUPLICATE_MAX_SHARE = 0.01

# ---- fixed values: split -----------------------------------------------------

RANDOM_STATE = 42
TEST_SIZE = 0.2
VAL_SIZE = 0.25

# ---- fixed values: grid searches ---------------------------------------------

LR_GRID_C = [0.01, 0.1, 1.0, 10.0]
GBT_GRID = {"maxIter": [100, 200], "maxDepth": [5, 6, 7], "stepSize": [0.05, 0.1],
            "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "1.0"]}
GRID_FOLDS = 3

# ---- fixed values: evaluation -----------------------------------------------

DECISION_THRESHOLD = 0.5
GINI_BANDS = [(0.5, "Excellent - Strong discrimination"), (0.4, "Good - Acceptable discrimination"),
              (0.3, "Fair - Minimum acceptable")]
GINI_ELSE = "Poor - Needs improvement"
KS_BANDS = [(0.4, "Excellent separation"), (0.3, "Good separation"), (0.2, "Acceptable separation")]
KS_ELSE = "Poor separation"

# ---- fixed values: scoring and decisions ------------------------------------

# Risk band on the unrounded probability: (upper bound exclusive, band, confidence, recommendation).
RISK_BANDS = [(0.10, "Low Risk", 0.95, "✓ APPROVE"), (0.25, "Medium Risk", 0.80, "⚠ REVIEW")]
RISK_ELSE = ("High Risk", 0.90, "✗ DECLINE")
NO_FACTORS = "No major risk factors identified"

FACTOR_FICO_VERY_LOW = "Very low credit score (subprime)"
FACTOR_FICO_BELOW_AVG = "Below-average credit score"
FACTOR_DTI_HIGH = "High debt-to-income ratio (>45%)"
FACTOR_DTI_ELEVATED = "Elevated debt-to-income ratio"
FACTOR_LTI_LARGE = "Large loan relative to income (>50%)"
FACTOR_LTI_MODERATE = "Moderate loan-to-income ratio"
FACTOR_EMP_SHORT = "Limited employment history (<2 years)"
FACTOR_LOW_INCOME = "Low annual income"
# thresholds of the standard rule set
FICO_VERY_LOW, FICO_BELOW_AVG = 620, 680
DTI_HIGH, DTI_ELEVATED = 0.45, 0.35
LTI_LARGE, LTI_MODERATE = 0.5, 0.35
EMP_SHORT_YEARS = 2
LOW_INCOME = 30000

# The basic rule set of the second scoring draft.
BASIC_DTI, BASIC_FICO, BASIC_LTI, BASIC_EMP = 0.4, 650, 0.5, 2
BASIC_FACTOR_DTI = "High debt-to-income ratio"
BASIC_FACTOR_FICO = "Low credit score"
BASIC_FACTOR_LTI = "High loan-to-income ratio"
BASIC_FACTOR_EMP = "Short employment history"

# Application limits: (field, lower, lower inclusive, upper, upper inclusive).
APPLICATION_LIMITS = [
    ("revenue", 0, False, 10_000_000, True),
    ("loan_amnt", 0, False, 1_000_000, True),
    ("fico_n", 300, True, 850, True),
    ("dti_n", 0, True, 1, True),
    ("emp_length_numeric", 0, True, 10, True),
]
LOAN_TO_REVENUE_MAX = 2
HIGH_DTI_WARNING = 0.8
FIELD_PREFIX = "body -> "
MSG_REQUIRED = "Field required"
MSG_GT = "Input should be greater than {}"
MSG_GE = "Input should be greater than or equal to {}"
MSG_LT = "Input should be less than {}"
MSG_LE = "Input should be less than or equal to {}"
MSG_LOAN_VS_REVENUE = "Value error, Loan amount (${}) exceeds 2x annual income (${})"

# Serving profile: defaults for fields an application does not carry.
SERVING_ISSUE_YEAR, SERVING_ISSUE_MONTH, SERVING_ISSUE_QUARTER = 2025, 12, 4
SERVING_PURPOSE = "debt_consolidation"
SERVING_HOME_OWNERSHIP = "RENT"
SERVING_HIGH_FICO = 700
SERVING_HIGH_DTI, SERVING_LOW_REVENUE = 0.36, 50000
SERVING_HIGH_LOAN, SERVING_LOW_FICO = 20000, 660

# The model-info record where the models' metadata says nothing.
MODEL_DISPLAY_NAME = "Credit Default Risk Predictor"
MODEL_VERSION = "1.0.0"
MODEL_INFO_FALLBACK = {
    "version": "1.0.0",
    "training_date": "2024-12-01",
    "performance": {"auc_roc": 0.781, "gini": 0.562, "ks_statistic": 0.438},
}
