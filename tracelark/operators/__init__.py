"""Operators over frame tables, decoded series and signal catalogues."""
