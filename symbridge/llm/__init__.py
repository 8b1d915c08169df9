"""Training-data operators on Spark; each module holds one operator."""
