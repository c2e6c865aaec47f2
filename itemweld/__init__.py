"""itemweld: find, group and price duplicate catalogue items on Spark."""
