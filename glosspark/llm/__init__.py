"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface; `queries.py`
derives the registered `opN_*` queries from them and `corpus_pipeline.py` at
the repository top chains five of them. Nothing else in glosspark imports
this package.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
