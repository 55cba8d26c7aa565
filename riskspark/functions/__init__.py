"""riskspark.functions."""
