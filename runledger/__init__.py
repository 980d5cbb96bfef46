"""Spark-native engine for run evidence: ingest, metrics, quality findings and comparisons.

Functions that run in Python workers are shipped by value, so a cluster needs no
installed copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

__all__ = ["Session", "compare_sessions", "inspect_source"]


def __getattr__(name: str):
    if name == "Session":
        from runledger.plans.sessions import Session

        return Session
    if name in __all__:
        from runledger.plans import inspect

        return getattr(inspect, name)
    raise AttributeError(name)
