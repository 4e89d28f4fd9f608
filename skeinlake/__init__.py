"""skeinlake: retrieval, ranking and curation of document memories on Spark."""
