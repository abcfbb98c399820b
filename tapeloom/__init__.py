"""Equity bars and news sentiment on Spark: every operator is DataFrame in, DataFrame out."""
