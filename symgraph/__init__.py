"""Spark-first analytics over a partitioned, typed property multigraph of source code.

Operators are lazy ``DataFrame -> DataFrame`` functions; nothing is collected to the driver
except counts, fixed-size dimensions and results whose size an argument bounds.
"""

__version__ = "0.1.0"
