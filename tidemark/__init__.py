"""Panel-wide marketing-mix analysis as plain PySpark DataFrame operators."""
