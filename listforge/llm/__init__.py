"""Operators for preparing training data; nothing outside this folder imports them."""

import os

from pyspark import cloudpickle

_root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if _root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and "site-packages" not in _root and os.getcwd() != _root:
    # The Python workers would not find the package: functions travel with their code.
    import listforge

    cloudpickle.register_pickle_by_value(listforge)
