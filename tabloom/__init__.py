"""A Spark-native engine that turns messy tables into clean, typed ones and answers SQL over them."""
