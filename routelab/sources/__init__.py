"""Readers and writers for evaluation runs, prompt files and training sets."""
