"""Operations of a training-data pipeline over documents, embeddings and pages."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
