"""ledgerloom.streaming."""
