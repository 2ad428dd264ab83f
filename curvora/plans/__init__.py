"""Plans: named chains of operator SQL."""
