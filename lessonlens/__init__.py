"""Classroom-engagement analytics as Spark jobs."""
