"""opstrata: a PySpark-native analytics engine for the activity and output of software-development agents."""
