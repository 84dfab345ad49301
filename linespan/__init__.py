"""linespan: line-addressed document analytics on Spark."""
