"""Readers and writers of the jobs' file formats."""
