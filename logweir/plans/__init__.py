"""Programs to DataFrames, and materialized views."""
