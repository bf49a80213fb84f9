"""Reading and writing: log files, host samples, networks, tables and CSV."""
