"""Leak-free, time-ordered features, ratings and model evaluation for head-to-head games, on Spark."""
