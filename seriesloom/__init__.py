"""Panel time-series analytics as composable DataFrame -> DataFrame functions."""

import sys

from pyspark import cloudpickle

# Small helpers travel with the tasks that use them; executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
