"""The pipe query language: text to syntax trees, without Spark."""
