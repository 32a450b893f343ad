"""Document-corpus analytics on Spark.

Builders take DataFrames and parameters and return DataFrames; none runs an
action unless its docstring says so.
"""
