"""offerlake: offer and price-listing analytics, written Spark-first."""
