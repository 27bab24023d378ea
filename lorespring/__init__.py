"""Text-corpus retrieval and conversation-memory analytics on Spark DataFrames."""
