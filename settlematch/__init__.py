"""settlematch: payment reconciliation jobs as Spark DataFrame programs."""
