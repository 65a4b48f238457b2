"""Document governance analytics as composable PySpark DataFrame operators."""
