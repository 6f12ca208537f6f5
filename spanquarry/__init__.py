"""Exact byte-span analytics over document collections, as Spark DataFrame plans."""
