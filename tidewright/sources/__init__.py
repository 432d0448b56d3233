"""Reading tables, files of earlier stages, and remote quotes."""
