"""veclens: per-token activation vectors on Spark.

Collects vectors from a text corpus, audits the chunks, fits and applies a
sparse autoencoder, and reports which features fire on which tokens.
"""

import sys

from pyspark import cloudpickle

# Functions of this package run inside Python workers. Pickling them by value
# spares every executor an installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
