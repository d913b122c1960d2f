"""Column functions. Everything here is a JVM expression unless its name ends in ``_udf``."""
