"""tessera: trace analytics and training-data operators as PySpark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["tessera"])
