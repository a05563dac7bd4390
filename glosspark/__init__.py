"""glosspark: parallel gloss/text corpus preparation and evaluation on Spark.

Every operator is a function from DataFrame (or Column) to DataFrame (or
Column) built from Spark SQL expressions, so Catalyst plans the whole chain.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
