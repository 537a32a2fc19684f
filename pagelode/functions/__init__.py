"""Column functions: text rules and their lexicon."""
