"""Plumbline: Spark operators for large collections of ordered measurement profiles.

A *profile* is a set of rows that share key columns (a well, a cast, a log) and are
ordered by a position column (depth).  Every operator takes a DataFrame holding many
profiles and returns a DataFrame.
"""
