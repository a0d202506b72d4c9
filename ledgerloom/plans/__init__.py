"""ledgerloom.plans."""
