"""Field, runoff and corpus analytics as PySpark DataFrame operators."""
