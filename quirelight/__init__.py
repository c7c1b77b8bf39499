"""A Spark-first engine for books, documents and training corpora."""
