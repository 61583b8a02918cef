"""Training-data operators: quality, PII, toxicity, BPE, language, licences, decontamination, dedup, shards, WARC."""
