"""Change-data-capture analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame. Stateless operators also accept
streaming DataFrames. ``changeflow.plans`` holds the registered queries.
"""
