"""Operations of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value: they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
