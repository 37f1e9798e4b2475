"""tessera: record linkage and training-data preparation as Spark plans."""
