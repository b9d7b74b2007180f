"""Operators for preparing training text: rules, duplicates, decontamination, secrets, tokens, archives, shards."""
