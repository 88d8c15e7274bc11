"""Column functions: every one takes and gives columns and stays inside the JVM."""
