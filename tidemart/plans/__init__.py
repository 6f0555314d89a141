"""Queries over the given tables: the warehouse's transforms applied to rows of the shapes that they take."""
