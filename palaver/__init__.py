"""Account-behaviour analytics for threaded discussions, written for PySpark."""
