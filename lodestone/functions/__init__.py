"""Scalar rules of the evidence graph as column expressions."""
