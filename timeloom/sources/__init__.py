"""Readers: each turns files or tables of one tool into mapped canonical rows."""
