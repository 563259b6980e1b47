"""Tabular feature engineering, model evaluation and training-data preparation on Spark."""
