"""Multi-operator plans and the registered queries."""
