"""Operators from DataFrame to DataFrame; ``keys`` makes each run per key."""
