"""PySpark-native analytics for spatially clustered panel data and the tables around it."""
