"""ledgerloom.operators."""
