"""Text functions: plain Python for one text, and their Spark forms."""
