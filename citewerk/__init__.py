"""citewerk: project-scoped, citable document analytics on PySpark."""
