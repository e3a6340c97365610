"""News analytics as Spark DataFrame operators.

``functions``  Column -> Column building blocks
``sources``    readers and sinks
``operators``  DataFrame -> DataFrame operators
``plans``      end-to-end jobs, the fixture views and the query catalogue
``streaming``  Structured Streaming jobs
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the task, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
