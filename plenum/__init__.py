"""Roll-call and floor-speech analytics on PySpark."""
