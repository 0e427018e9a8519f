"""Readers and writers of the engine's file formats. Every reader gives a DataFrame; nothing is collected."""
