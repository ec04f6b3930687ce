"""bytewake: attributed traffic accounting on Spark.

Transfer samples go in, byte counters per durable identity come out, kept in
minute, hour, day and month tables.  Every operator takes and returns
DataFrames; clocks, zones and settings are arguments, so results repeat.
"""

__version__ = "0.1.0"
