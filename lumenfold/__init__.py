"""A PySpark engine for medical-image records: metadata, pixels, geometry and labels as DataFrames."""
