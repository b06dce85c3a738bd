"""Email-risk analytics on Spark: intake, features, scoring, store and corpus reports as DataFrame jobs."""
