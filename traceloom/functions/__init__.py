"""Column expressions shared by the operators; all JVM-side unless a docstring says otherwise."""
