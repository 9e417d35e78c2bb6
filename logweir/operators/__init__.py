"""Commands as functions: a DataFrame and arguments to a DataFrame.

Where rows have an order that matters, it is passed as a list of (column, descending), since Spark's rows have none.
"""
