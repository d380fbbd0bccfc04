"""Response-matrix analytics as Spark DataFrame operators.

Long tables of (entity, item, signed value) go in; agreement, factor,
neighbour, placement and ranking tables come out.  Every public operator takes
DataFrames and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
