"""Pipelines over operators: building an index, storing generations, answering queries."""
