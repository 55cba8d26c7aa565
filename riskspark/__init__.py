"""riskspark: loan-book risk analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions. Data-dependent steps are split into ``fit_*`` (one fused
aggregate, a handful of scalars back to the driver) and ``apply_*`` (narrow
column expressions, whole-stage generated).
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
