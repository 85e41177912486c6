"""helixframe: sequence and text analytics as PySpark DataFrame operators."""
