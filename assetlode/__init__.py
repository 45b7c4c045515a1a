"""assetlode: inventory analytics for captured script assets, on Spark DataFrames."""
