"""Personal-data exposure audits over tables of screen text, on Spark."""
