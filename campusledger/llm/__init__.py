"""Operators for building training corpora at scale.

Nothing else in the library imports this subpackage. ``queries.py`` lists the
registered queries; every other module holds one operator or a shared helper.

Functions of this subpackage that run inside tasks travel with the task by
value, so executors need the Python libraries used here but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
