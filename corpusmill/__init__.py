"""corpusmill: document-corpus ETL, batched retrieval and service analytics as Spark plans."""

__version__ = "0.1.0"
