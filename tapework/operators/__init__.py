"""Relational operators on tokens, intervals, decisions and snapshots."""
