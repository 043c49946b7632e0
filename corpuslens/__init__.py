"""Corpus analytics on Spark: text cleaning, n-grams, entities, topics, vectors, outliers."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: what runs there is shipped by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
