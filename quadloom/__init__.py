"""quadloom: a Spark-first engine for RDF-style graphs and their entity views."""

__version__ = "0.1.0"
