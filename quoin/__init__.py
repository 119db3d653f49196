"""Marketplace analytics on PySpark: catalog, orders, settlement, ratings and data quality as DataFrame operators."""
