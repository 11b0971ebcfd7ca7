"""Analytics and decision engine for panel data, written for Spark."""
