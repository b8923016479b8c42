"""Evidence-first dataset engine on PySpark."""
