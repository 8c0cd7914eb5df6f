"""Training-data operators. Nothing else in the library imports this package.

Functions of this package that run in executors travel by value, so that an
executor needs no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
