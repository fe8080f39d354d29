"""Readers and writers of corpora, vocabularies and models."""
