"""Topic modelling and text analytics as PySpark dataflow."""
