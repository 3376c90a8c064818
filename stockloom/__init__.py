"""Inventory analytics for manufacturing ERP data, on Spark."""
