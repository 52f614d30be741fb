"""The same counters and cleaning over streams."""
