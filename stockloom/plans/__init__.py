"""Named queries over a data folder, with the SQL that gives the same rows."""
