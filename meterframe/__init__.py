"""Usage metering and analytics expressed as Spark DataFrame plans."""
