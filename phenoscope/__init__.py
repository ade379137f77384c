"""Multi-temporal spectral analytics and corpus preparation on Spark."""
