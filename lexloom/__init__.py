"""Localization data processing on Spark: archives, scripts and catalogs as DataFrames."""
