"""vitalis: clinical decision-support analytics as declarative PySpark plans."""
