"""Operators for building training data, each a Spark job over whole tables."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])
