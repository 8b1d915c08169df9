"""DataFrame-to-DataFrame operators of the symbol-mapping jobs."""
