"""Contrast-set mining over Spark DataFrames: what is unusual about each group of records."""

import sys

from pyspark import cloudpickle

from contrastmill.operators.features import FeatureSet, FeatureSpec
from contrastmill.operators.words import top_words
from contrastmill.plans.batch import BatchResult, batch_by_channel
from contrastmill.plans.deviations import Deviations, Settings, find_deviations

__all__ = [
    "BatchResult",
    "Deviations",
    "FeatureSet",
    "FeatureSpec",
    "Settings",
    "batch_by_channel",
    "find_deviations",
    "top_words",
]

# Functions that run in tasks travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
