"""binomia: organism-name extraction and resolution over text corpora, on Spark DataFrames."""
