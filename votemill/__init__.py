"""Voting-record and debate analytics as PySpark DataFrame operators."""
