"""quoteloom: a PySpark engine for price benchmarking and product matching."""
