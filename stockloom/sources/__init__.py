"""Schemas, readers and writers, and the ERP views over star-schema tables."""
