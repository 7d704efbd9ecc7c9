"""Spark-native preparation, layout, planning and checking of slide content."""
