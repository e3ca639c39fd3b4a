"""Operators for preparing training data.

Their functions travel to the executors with their code, so executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
