"""Readers, writers and providers of bars."""
