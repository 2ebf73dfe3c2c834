"""The dialect's front end: text to syntax tree to Spark SQL."""
