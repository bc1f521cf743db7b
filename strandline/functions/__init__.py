"""Column functions. All of them stay JVM-side unless the name ends in ``_udf``."""
