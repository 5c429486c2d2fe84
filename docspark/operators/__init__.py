"""Document operators: DataFrames in, DataFrames out, keyed by doc_id and explicit ordinals."""
