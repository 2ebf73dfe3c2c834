"""One query for each operator of the dialect, with the SQL that checks it."""
