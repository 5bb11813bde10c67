"""tallyscript: Spark-native evaluation of speech transcripts."""

__version__ = "0.1.0"
