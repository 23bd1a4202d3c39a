"""graticule: a document-retrieval and analytics engine written as Spark plans."""
