"""Graph robustness analytics and training-data operators on Spark."""
