"""Spark-native engine for collections of RIFF-contained raster images."""
