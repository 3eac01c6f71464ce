"""The ontology, the views over the sample tables, and the registered queries."""
