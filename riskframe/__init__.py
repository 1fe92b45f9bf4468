"""riskframe: tabular records to risk-score evaluations, as lazy Spark DataFrames."""
