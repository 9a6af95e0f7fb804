"""Readers, writers and the adapters from generic tables to the domain tables."""
