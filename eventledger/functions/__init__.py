"""Scalar rules as SQL expression text.

Each function takes SQL expressions and returns one. Plans are built anew for every
micro-batch, and a text reaches the JVM in one call where a tree of Column objects
needs hundreds.
"""
