"""SQL functions and views over a map."""
