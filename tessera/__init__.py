"""tessera: an object-graph query layer, change-stream layer and function library on PySpark."""
