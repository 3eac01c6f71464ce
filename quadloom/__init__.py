"""Knowledge-graph and hybrid-retrieval analytics on Apache Spark."""
