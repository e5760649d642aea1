"""Knowledge-graph retrieval and analytics as Spark DataFrame programs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from graphloom.graph import PropertyGraph
from graphloom.session import build_session

# Python workers get the few functions they run by value, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["PropertyGraph", "build_session"]
