"""siftline: batch hybrid retrieval, evaluation and catalog processing on Spark DataFrames."""
