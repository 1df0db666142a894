"""fathomgrid: a PySpark engine for code intelligence, retrieval and training-data preparation."""
