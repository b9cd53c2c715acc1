"""millrace: text-corpus curation and paired model evaluation on Spark DataFrames."""
