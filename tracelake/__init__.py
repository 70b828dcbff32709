"""Multi-channel time-series recordings on Spark: containers, codec, signal algebra, events."""
