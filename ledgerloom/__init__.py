"""ledgerloom: retail and corpus analytics expressed as Catalyst plans."""
