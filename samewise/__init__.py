"""samewise: finding and proving redundancy in text corpora with PySpark DataFrames."""
