"""millrace: point-in-time feature analytics and corpus preparation on Spark."""
