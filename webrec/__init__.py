"""webrec: web-page record extraction, entity resolution, quality scoring and
content analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# task functions travel with their helpers, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
