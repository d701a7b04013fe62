"""Operators on tables of documents: detection, location, redaction, classification, review and history."""
