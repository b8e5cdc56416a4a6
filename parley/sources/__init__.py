"""Reading landed files and writing archive, export and log files."""
