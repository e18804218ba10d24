"""Shelfrank: retail analytics and item ranking as batch Spark plans."""
