"""ledgerloom.sources."""
