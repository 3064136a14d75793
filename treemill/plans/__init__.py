"""Session helpers and the registered queries."""
