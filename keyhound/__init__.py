"""Find secrets and other sensitive values in files, documents and tables with Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so a cluster needs no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
