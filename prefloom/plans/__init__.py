"""Named queries, their SQL, and the end-to-end pipelines."""
