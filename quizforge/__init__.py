"""Curation, evaluation and adaptive-test analytics for question-and-answer corpora, as DataFrame transformations."""
