"""The library's operators as named queries over the given tables, each with its SQL twin."""

import sys

from pyspark import cloudpickle

from queryset import answers, checks, files, fitted, hr, ledger, marts, merging, models, quality, records, series, signals, splits, stored, streams
from queryset.base import ORACLES, QUERIES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ORACLES", "QUERIES", "answers", "checks", "files", "fitted", "hr", "ledger", "marts", "merging", "models", "quality",
    "records", "series", "signals", "splits", "stored", "streams",
]
