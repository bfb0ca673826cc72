"""skyspark: star-catalogue astrometry and large-table analytics on Spark DataFrames."""

__version__ = "0.1.0"
