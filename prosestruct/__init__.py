"""prosestruct: text-structure analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
