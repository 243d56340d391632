"""A grid-function analytics engine on Spark: every grid point is a row, every operator goes from DataFrame to DataFrame."""
