"""End-to-end jobs, derived input views and the registered queries."""
