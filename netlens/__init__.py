"""Network threat analytics as DataFrame-to-DataFrame operators on Spark."""
