"""Objects sent to the tasks of a job."""

from __future__ import annotations

from pyspark import SparkContext, cloudpickle


class Shared:
    """A broadcast that carries the code of its object along, so executors need no install. Each task unpacks it once.

    For lookup data and models of fixed size.
    """

    def __init__(self, sc: SparkContext, value):
        self._bytes = sc.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._bytes.value)
        return self._value
