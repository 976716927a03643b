"""Document-corpus analytics as DataFrame operators on Spark."""
