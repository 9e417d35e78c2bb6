"""Expressions: coercion rules, scalar functions, aggregates and format parsers, all as Spark columns."""
