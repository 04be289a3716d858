"""textguard: prompt, response and document guardrail analytics on Spark."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions of this package to executors by value, so a
# cluster needs no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
