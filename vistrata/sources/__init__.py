"""Readers, the report sink and the model store."""
