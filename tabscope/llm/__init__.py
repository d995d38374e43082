"""Operations of a large training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need no copy of this package: functions travel with their tasks.
register_pickle_by_value(sys.modules[__name__])
