"""Millrace: web content and traffic analytics as Spark DataFrame jobs."""
