"""Operators for large training-text corpora.

Nothing outside this subpackage imports it.  Functions sent to executors are
pickled by value, so executors need the libraries but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
