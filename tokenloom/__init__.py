"""Static text embeddings as Spark jobs: corpus shaping, vocabularies, encoding, fitting, search."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the Python workers with the plan, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
