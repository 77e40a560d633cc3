"""heddle: a PySpark-native analytics engine for version-control data.

The library holds content-addressed objects, commit graphs, directory trees and
named references as plain DataFrames and answers fixed questions about them.
"""

__version__ = "0.1.0"
