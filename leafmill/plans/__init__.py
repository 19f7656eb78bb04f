"""Plans of changes: a plan is a DataFrame, applying it writes a new version of a table."""
