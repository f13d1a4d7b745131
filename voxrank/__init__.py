"""voxrank: ranked, evidence-backed findings from large tables of customer reviews."""

import sys

from pyspark import cloudpickle

# Ship this package's Python functions with each job, so that executors need no
# installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
