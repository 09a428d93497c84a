"""Evidence auditing and training-data operators as Spark DataFrame pipelines."""

import sys

from pyspark import cloudpickle

# Task code travels with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
