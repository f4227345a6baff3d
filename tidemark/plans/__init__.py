"""Compositions: the master build, the inputs drawn from the test tables, and the query catalogue."""
