"""Cell-level change history and time travel over keyed tables, on Spark DataFrames."""

__version__ = "0.1.0"
