"""sieve: record screening on Spark.

Cleans and serialises descriptor columns, encodes text to vectors, makes
stratified splits / folds / bootstrap replicates, fits standardise -> PCA ->
classifier pipelines, tunes decision thresholds, selects models, and reports
how far a ranked screen can be trusted.  Everything is expressed with
DataFrames, window functions and Spark ML.
"""

import sys as _sys

# Pandas UDFs and grouped fits call helpers defined in this package.  Pickling the
# package's functions by value makes every such closure self-contained, so Python
# workers need not be able to import ``sieve`` (a session started elsewhere, an
# executor without the package on its path).  On a cluster the package can still
# be shipped with ``--py-files``; this only removes the hard requirement.
from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["session"]
