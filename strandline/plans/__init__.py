"""Registered queries, each composed of operators over the tables of a directory."""
