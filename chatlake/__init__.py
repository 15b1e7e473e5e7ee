"""chatlake: a Spark-native analytics library for archives of exported assistant conversations."""
