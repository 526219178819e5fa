"""Registered query plans, grouped by topic; importing a module registers its queries."""
