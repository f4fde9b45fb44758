"""docrows: documents to analysis-ready tables, as Spark jobs."""
