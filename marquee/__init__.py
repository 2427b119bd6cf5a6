"""Event-catalogue and interaction analytics as plain PySpark DataFrame functions."""
