"""skein: a Spark-first engine for mail, attachment, vector and event data."""
