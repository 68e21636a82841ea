"""Training-data operators: packing, tokenising, fingerprints, joins, deduplication, scans, formatting, WARC.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
