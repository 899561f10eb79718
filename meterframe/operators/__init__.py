"""Query, ingest, quota, alert and retention operators over the usage-event table."""
