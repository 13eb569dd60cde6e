"""Training-data operators: deduplication, extraction, tokenising, scoring and
decontamination of text corpora.  Nothing else in the library imports this."""
