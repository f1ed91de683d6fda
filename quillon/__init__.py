"""quillon: interaction-table, token-corpus and codebook analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with their code, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
