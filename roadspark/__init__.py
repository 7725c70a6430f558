"""Road-network and vehicle-routing analytics on PySpark."""
