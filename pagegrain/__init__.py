"""Pagegrain: an HTML analytics engine built on PySpark DataFrames."""
