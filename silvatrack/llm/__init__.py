"""Training-data operators: extraction, language, licences, secrets, mixing, near-duplicates, fingerprints,
decontamination, token files and sharding. Nothing else in the library imports this subpackage."""
