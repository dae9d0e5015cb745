"""Operators for preparing training corpora, each over whole tables of any size."""
