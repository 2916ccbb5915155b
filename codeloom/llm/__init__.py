"""Training-data operators: one module per operator, their queries and SQL checks.

Functions of this package travel inside the tasks that call them, so that workers need no copy of
it on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
