"""Named queries bound to tables, with SQL twins."""
