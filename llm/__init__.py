"""Operators of a training-data pipeline; their registered queries are in ``llm.queries``.

Code that runs in tasks travels with them (pickled by value), so Python workers need
neither this package installed nor the driver's path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
