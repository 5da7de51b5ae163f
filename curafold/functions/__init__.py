"""Column-level building blocks: no function here triggers a job or a shuffle."""
