"""Invoice and receipt text to structured records, as DataFrame operations."""
