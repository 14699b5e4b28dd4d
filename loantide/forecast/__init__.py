"""Forecasts of monthly series, many at a time.

Series come from tables already aggregated to one row per series and month.
Where a method needs the whole series it is held as one array per row, whose
length the calendar bounds. No operator forms pairs of rows.
"""

import sys

from pyspark import cloudpickle

# Fitting functions travel to the workers with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules["loantide"])
