"""Scalar functions as Column expressions. All stay in the JVM unless their docstring says otherwise."""
