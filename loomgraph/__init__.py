"""loomgraph: knowledge-graph and question-answering analytics, expressed as Spark plans."""
