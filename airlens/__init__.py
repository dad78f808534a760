"""airlens: broadcast and IPTV analytics as Spark DataFrames and streams."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions and stream processors travel to executors by value: no installation or path is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
