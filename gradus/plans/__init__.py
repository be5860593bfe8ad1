"""Registered queries with their SQL, a module for each part of the inventory."""
