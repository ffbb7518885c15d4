"""Operators for preparing language-model training data on Spark.

Each module holds one operator; ``registry`` lists their queries and SQL.
Functions sent to executors carry their code with them, so executors need the
third-party libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
