"""Readers and writers of pages, accounts, logs, embeddings and index versions."""
