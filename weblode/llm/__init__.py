"""Operations for preparing training data from documents, vectors and conversations.

Nothing else in the library imports this subpackage. Functions that run in tasks
are sent by value, so workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
