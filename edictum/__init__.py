"""edictum: governed event-condition-action rule evaluation as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
