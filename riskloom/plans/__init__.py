"""End-to-end plans and the registered queries."""
