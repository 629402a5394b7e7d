"""Readers and writers: raw posts, users, benchmarks, word lists, panels and the export manifest."""
