"""quillspark: full-text, semantic and hybrid search plus corpus processing on Spark DataFrames."""
