"""weftline: text requests and training text prepared with Spark plans."""
