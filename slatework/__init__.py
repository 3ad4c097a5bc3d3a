"""Feature, slate and backtest operators for event-level sports data, written as Spark DataFrame transformations."""
