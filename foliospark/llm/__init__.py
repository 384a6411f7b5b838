"""Training-data operators: dedup, extraction, token accounting, decontamination,
secret scanning, packing, toxicity.  Nothing else in the library imports this."""
