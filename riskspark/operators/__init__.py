"""riskspark.operators."""
