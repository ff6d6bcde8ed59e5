"""Insurance lakehouse analytics expressed as PySpark DataFrame jobs."""
