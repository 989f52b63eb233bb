"""Operators over DataFrames: index, ranking, graph, vectors, understanding, answers, pages, portal, operations."""
