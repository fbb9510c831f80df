"""Operators for preparing language-model training data.

Task functions are shipped by value, so that workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
