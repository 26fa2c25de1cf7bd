"""Writers of structures, tables and projects."""
