"""Column functions: everything here stays inside JVM code generation."""
