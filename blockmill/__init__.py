"""blockmill: corpus preparation and model-structure queries on PySpark."""
