"""Configuration, the reconciliation plan and what is judged from its result."""
