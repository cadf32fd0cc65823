"""Bulk land-parcel screening on Spark: text to polygons, spatial joins, rules, history."""
