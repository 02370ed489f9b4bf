"""Web-request threat triage as Spark DataFrame transformations."""
