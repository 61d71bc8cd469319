"""SPARQL queries and updates over RDF graphs as DataFrame plans."""
