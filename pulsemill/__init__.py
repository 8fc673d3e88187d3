"""Signal-window analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions sent to the executors travel with their code, wherever the driver was started
cloudpickle.register_pickle_by_value(sys.modules[__name__])
