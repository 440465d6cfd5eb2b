"""cohortlake: cohort building, leakage control, region tables and score audits on Spark."""
