"""quillspark: text analytics, retrieval and training-data preparation on Spark DataFrames."""
