"""Column expressions: everything runs inside the JVM, without Python UDFs."""
