"""evalspark: Spark-native preparation, profiling, augmentation and scoring of
labelled decision data.

Every operator is a plain ``DataFrame -> DataFrame`` function built from Spark SQL
expressions; nothing is collected to the driver except bounded summaries.
"""

__version__ = "0.1.0"
