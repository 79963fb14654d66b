"""strataloom: data profiling and knowledge-graph analytics as Spark DataFrame operators.

Every operator takes DataFrames and parameters and gives a DataFrame back, so
plans stay visible to Catalyst from scan to sink.
"""

__version__ = "0.1.0"
