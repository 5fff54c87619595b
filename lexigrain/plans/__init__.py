"""Registered queries: engine operators bound to the driver's tables."""
