"""Column functions: text, URLs, time, keys, music theory and small decision rules. All are Catalyst expressions."""
