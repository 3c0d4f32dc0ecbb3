"""Readers of usage exports, and adapters of other tables to the canonical usage row."""
