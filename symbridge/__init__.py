"""Spark jobs that carry symbol identifiers from one build of a program to the next."""
