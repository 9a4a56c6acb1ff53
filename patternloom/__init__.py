"""Emerging-pattern mining as composable Spark DataFrame operators."""
