"""tidemill: a time-series point store and a training-data toolkit on PySpark.

Functions that run on executors are pickled by value, so a cluster needs no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
