"""Column functions: campaign codes, URLs, calendar periods, ratios."""
