"""Training-data operators: media columns, WARC, deduplication, tokenising, packing, classifying, licence scans."""
