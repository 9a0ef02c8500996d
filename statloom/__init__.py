"""statloom: rating and scouting analytics as Spark DataFrame jobs."""
