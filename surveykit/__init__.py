"""Survey-log analytics on Spark: every operator is ``DataFrame -> DataFrame``."""
