"""sentloom: sentence-vector data sets as Spark jobs.

Text corpora, caption tables and sentence pairs become vocabulary-encoded training tables;
sentences become vectors; vectors are compared and scored. Every public function takes and
returns DataFrames (or Columns) and leaves partitioning and shuffles to Spark.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EOS = "<eos>"
UNK = "<unk>"
EOS_ID = 0
UNK_ID = 1
