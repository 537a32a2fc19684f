"""Ranking, retrieval, evidence, metric and sufficiency operators."""
