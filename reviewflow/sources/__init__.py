"""Files, topics and tables the operators read and write."""
