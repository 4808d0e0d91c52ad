"""quillmesh: document analytics and semantic retrieval as PySpark DataFrame programs.

Functions shipped to executors are pickled by value, so a cluster needs only the
public libraries (pyspark, numpy, pandas, pyarrow), not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
