"""docloom: document analytics on PySpark."""
