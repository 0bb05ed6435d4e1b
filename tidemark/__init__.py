"""Point-in-time analytics on PySpark: as-of features, ratings, evaluation, data quality."""
