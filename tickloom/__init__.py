"""A PySpark-native market analytics engine; see README.md."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them: no package needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
