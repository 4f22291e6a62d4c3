"""Operators for large text and vector collections: the sidecar texts, object keys and feature rows of a study.

Nothing else in the library imports this package. Its task functions are shipped by value: executors need numpy and
pyarrow (and tokenizers or tiktoken for the token operators), but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
