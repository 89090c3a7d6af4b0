"""boardlake: listings analytics on PySpark."""

import sys

from pyspark import cloudpickle

# The few Python functions travel inside the job itself, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
