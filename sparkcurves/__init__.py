"""Discount curves on Spark: many curves and valuation dates in one job."""
