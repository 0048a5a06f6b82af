"""Registered queries: Spark plans over the driver tables and their SQL oracles."""
