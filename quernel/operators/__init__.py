"""Operators from DataFrame to DataFrame: lazy, declarative, without Python rows."""
