"""A fixed demonstration scorecard.

The studied system ships no fitted coefficients, so scoring and linear
attribution are value-checked with this fixed coefficient table (our own
parameter, in manifest order). Production scoring passes the coefficients of
a model fitted by ``operators.train`` instead; the operators take any table.
"""

# Intercept and weights on the scaled 43-column serving/training layout.
INTERCEPT = -1.35
COEFFICIENTS = {
    "revenue": -0.18,
    "loan_amnt": 0.12,
    "fico_n": -0.42,
    "dti_n": 0.21,
    "emp_length_numeric": -0.05,
    "loan_to_income": 0.27,
    "DTI_ratio": 0.08,
    "issue_year": 0.03,
    "issue_month": 0.01,
    "issue_quarter": -0.01,
    "employment_stable": -0.06,
    "high_fico": -0.22,
    "is_homeowner": -0.04,
    "has_mortgage": -0.07,
    "is_renter": 0.09,
    "risky_loan_purpose": 0.16,
    "safe_loan_purpose": -0.05,
    "high_debt_low_income": 0.19,
    "high_loan_low_fico": 0.24,
    "purpose_credit_card": -0.10,
    "purpose_debt_consolidation": 0.02,
    "purpose_educational": 0.11,
    "purpose_home_improvement": -0.03,
    "purpose_house": 0.05,
    "purpose_major_purchase": -0.02,
    "purpose_medical": 0.06,
    "purpose_moving": 0.12,
    "purpose_other": 0.08,
    "purpose_renewable_energy": 0.04,
    "purpose_small_business": 0.31,
    "purpose_vacation": 0.03,
    "purpose_wedding": -0.01,
    "home_ownership_n_OTHER": 0.05,
    "home_ownership_n_OWN": -0.02,
    "home_ownership_n_RENT": 0.07,
    "income_bracket_25K-50K": -0.04,
    "income_bracket_50K-75K": -0.09,
    "income_bracket_75K-100K": -0.13,
    "income_bracket_>100K": -0.17,
    "fico_bracket_Fair": -0.20,
    "fico_bracket_Good": -0.45,
    "fico_bracket_Very Good": -0.70,
    "fico_bracket_Excellent": -0.95,
}

# The numeric-only draft (ten scaled numeric features).
NUMERIC_INTERCEPT = -1.30
NUMERIC_COEFFICIENTS = {
    "revenue": -0.20,
    "loan_amnt": 0.15,
    "fico_n": -0.55,
    "dti_n": 0.25,
    "emp_length_numeric": -0.06,
    "loan_to_income": 0.30,
    "DTI_ratio": 0.10,
    "issue_year": 0.02,
    "issue_month": 0.01,
    "issue_quarter": -0.01,
}
