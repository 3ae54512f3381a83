"""Readers and writers of the log and component formats, and directory discovery."""
