"""Scalar rules: URLs, HTML, HTTP headers and canonical numbers."""
