"""Readers and writers of lexicons, corpora, models and reports."""
