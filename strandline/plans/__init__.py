"""Query plans: validation, compilation, and the registered queries."""
