"""tidepool: a Spark-first engine for website intelligence and corpus preparation."""
