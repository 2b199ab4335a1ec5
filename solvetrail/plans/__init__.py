"""Compositions of operators: the solved set, its clean form, the analytics, the jobs."""
