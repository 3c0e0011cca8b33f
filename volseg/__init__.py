"""volseg: segmentation tables and training-data operators on Spark DataFrames."""
