"""Information-flow analytics of multivariate time series on Spark."""
