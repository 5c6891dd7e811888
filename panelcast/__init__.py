"""Quarterly panels, leakage-safe features and forecast evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the task, so executors do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
