"""driftspark: structural-drift analytics as Spark DataFrame operators."""
