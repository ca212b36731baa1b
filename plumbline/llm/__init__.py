"""Operators for preparing language-model training data.

Functions of this subpackage that run inside tasks travel with the job (pickled
by value), so executors need only the third-party libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
