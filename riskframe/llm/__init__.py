"""Operators for preparing training data, one module each; nothing else imports them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors whole, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
