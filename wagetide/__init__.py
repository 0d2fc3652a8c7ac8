"""Recurring-income detection over bank credits, for many analyses in one Spark job."""
