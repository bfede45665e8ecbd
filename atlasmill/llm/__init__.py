"""Corpus preparation operators: media, URL filters, deduplication, WARC, packing, classifiers, decontamination."""
