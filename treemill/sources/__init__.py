"""Readers: annotated text, answer archives, trackers, prompts, files, and an injectable chat client."""
