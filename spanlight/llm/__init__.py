"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Functions that run on
executors are shipped by value, so a worker needs numpy, pyarrow and the named
codec or tokenizer libraries, but not this package on its import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
