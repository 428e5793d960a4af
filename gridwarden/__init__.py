"""A PySpark-native engine for data-quality analytics over workbooks and tables seen as sheets."""
