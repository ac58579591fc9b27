"""Column functions: calendar, text and codes."""
