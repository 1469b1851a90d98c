"""Procurement-notice processing as ordinary Spark DataFrame jobs."""
