"""docloom: a document query, change and training-data engine on Spark."""
