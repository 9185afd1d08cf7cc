"""starbraid: star-schema analytics, panel econometrics and inference as Spark DataFrame operators."""
