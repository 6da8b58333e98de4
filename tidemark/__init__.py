"""Spark-native curation and evaluation of image-segmentation corpora."""
