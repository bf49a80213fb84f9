"""DataFrame-to-DataFrame operators over access and error logs."""
