"""riskframe: cohort risk analytics as plain Spark DataFrame functions."""
