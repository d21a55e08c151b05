"""riskfeat: per-applicant feature tables, encoders, scorers and stacks on Spark."""
