"""Operations for large training-data pipelines. Nothing outside this package imports it."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The code of this package travels to the executors with the functions that use it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
