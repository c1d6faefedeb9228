"""Reading and writing the tables, stages and submissions."""
