"""Coding-agent usage analytics as plain Spark DataFrame operators."""
