"""Search-quality analytics on Spark: sessions, daily health scores, anomalies, explanations."""
