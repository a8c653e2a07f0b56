"""Reading curves: parquet tables, array archives, features from images."""
