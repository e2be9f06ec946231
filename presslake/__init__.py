"""presslake: news and web-article monitoring as PySpark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# The few Python batch functions travel to the executors with the job, so the package is only needed on the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
