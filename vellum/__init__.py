"""vellum: document-quality analytics as Spark DataFrame transformations."""
