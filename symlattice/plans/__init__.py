"""Registered queries and the facade that puts operators together."""
