"""scriptloom: timed-transcript analytics expressed as Spark DataFrame plans."""
