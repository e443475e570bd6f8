"""quern: analytics, statistics and learning as Spark plans."""
