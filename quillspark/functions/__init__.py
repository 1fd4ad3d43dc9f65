"""Column functions: everything here stays inside generated JVM code unless it says otherwise."""
