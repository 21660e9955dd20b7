"""Cited retrieval and corpus analytics as DataFrame transformations."""
