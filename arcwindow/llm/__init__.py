"""Operators for building training corpora: deduplication, mixing, scans, scores and counts.

Nothing outside this folder imports it. Its functions travel to Python workers by value, so a
cluster needs no copy of the package on its executors.

All operators share some rules about documents. A row is a document; a null text is an empty one.
Columns that an operator does not name are ignored, whatever they are called. A row without an id
can neither be linked with others nor come before them, and is reported with a null id.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
