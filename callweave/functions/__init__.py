"""Scalar and text functions: Column expressions, and span functions for texts where offsets matter."""
