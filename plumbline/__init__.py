"""plumbline: document-conformance analytics as Spark DataFrame transformations."""
