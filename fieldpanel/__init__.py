"""Panel analytics on Spark: repeated irregular observations joined to occasional surveys."""
