"""driftnet: a Spark-first engine for cataloguing media releases from a discovery stream."""
