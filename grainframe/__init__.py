"""Object-measurement analytics and text-corpus operators as Spark DataFrames."""
