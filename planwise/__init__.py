"""Workload analytics over query logs, plan logs and cost logs, as Spark jobs."""
