"""Readers and writers: the note store, directory import, file export."""
