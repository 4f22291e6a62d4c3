"""evoq: trial-level evoked-response analytics on Spark DataFrames."""

from pyspark import cloudpickle

from evoq.functions import kernels, trees

# Executors need numpy and Arrow, but not this package.
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(trees)
