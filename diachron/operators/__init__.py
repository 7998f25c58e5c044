"""Relational operators: networks, dynamics, conductance, retrieval, prediction."""
