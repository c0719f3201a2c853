"""Revised panel time series and probabilistic forecasts on Spark."""
