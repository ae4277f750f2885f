"""Panel analytics on Spark: window, as-of, cross-sectional, ranking and temporal-validation operators as DataFrame plans."""
