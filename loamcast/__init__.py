"""loamcast: typed ingest, columnar layout and Parquet writing on Spark DataFrames."""
