"""Named queries over the tables of a data folder."""
