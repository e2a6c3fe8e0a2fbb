"""Training-data operators: scans, sharding, scoring, joins, packing and mixing."""
