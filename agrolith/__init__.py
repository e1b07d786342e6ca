"""PySpark-native analytics engine: district climate, drought, crop and sowing intelligence."""
