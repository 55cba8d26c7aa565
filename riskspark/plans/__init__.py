"""riskspark.plans."""
