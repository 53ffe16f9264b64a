"""Column functions: bit slices of payloads, number and time formatting, search text."""
