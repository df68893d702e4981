"""tessera: text retrieval, conversational memory and corpus preparation on Spark DataFrames."""
