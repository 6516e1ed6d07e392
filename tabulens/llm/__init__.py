"""Training-data operators: extraction, filtering, deduplication, mixing, sharding and packing.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and column names, keeps its intermediates in the shared checkpoint folder and
returns a DataFrame; ``queries`` registers the thin ``opN_*`` queries.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
