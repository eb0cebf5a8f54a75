"""Spark-native evaluation of text classifiers: dataset preparation, metrics
overall and per group, error analysis, paired model comparison, text
features and explanations. Every operator is a DataFrame -> DataFrame
function; nothing holds a global session."""

__version__ = "0.1.0"
