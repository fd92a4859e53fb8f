"""Relational operators: duplicates, ranking, similarity, plan, peers, telemetry."""
