"""What is decided on the driver before a job runs: query texts, hints, and the verb facade."""
