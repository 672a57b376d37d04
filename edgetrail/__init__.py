"""Access-log graph analytics for token-protected video delivery, on Spark."""
