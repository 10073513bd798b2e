"""pageloom: crawled web pages to structured, searchable tables, as Spark jobs."""
