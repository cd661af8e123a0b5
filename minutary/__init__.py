"""Session-record analytics on Spark: documents to task candidates, commands, and an audited task history."""
