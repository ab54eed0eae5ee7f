"""veinmap: column- and object-lineage analytics on Spark DataFrames."""
