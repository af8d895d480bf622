"""Catalog matching, change data, pricing and table extraction as Spark DataFrame operators."""
