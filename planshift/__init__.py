"""Plan-change propensity analytics on PySpark: label, join, profile, select, fit, evaluate, explain."""
