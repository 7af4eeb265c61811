"""A PySpark-native engine for collections of files, documents and timelines."""
