"""folioforge: curation of library catalogue data (works, expressions, manifestations) on PySpark."""
