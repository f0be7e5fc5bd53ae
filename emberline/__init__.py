"""Emberline: log analytics and anomaly detection as plain Spark DataFrames.

Every operator is ``f(df, **params) -> DataFrame``: lazy, free of hidden clocks
and of driver-side row collection, so the same function serves batch jobs and
Structured Streaming micro-batches.
"""

from pyspark import cloudpickle

from . import functions, operators, shared, sinks, sources, streaming

# Small NumPy and Arrow kernels travel by value with what uses them. The corpus operators keep memories from task to task,
# so they come as the Python file that the session adds.
for _part in (functions, operators, shared, sinks, sources, streaming):
    cloudpickle.register_pickle_by_value(_part)

__version__ = "0.1.0"
