"""Jobs that write the managed tables: the tag log and the tag policies."""
