"""gleanings: content-curation analytics expressed as Spark plans."""
