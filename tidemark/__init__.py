"""PySpark jobs for finding and tracking policy documents in large page and record collections."""
