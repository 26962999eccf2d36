"""curbcast: a Spark-native probability-field engine for courier positioning.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  See README.md for the map of the package.
"""
