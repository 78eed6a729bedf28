"""Segmentation of images and other tables of numeric vectors by clustering, on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions of this package travel to the executors by value: no installation is needed there
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
