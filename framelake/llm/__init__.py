"""Operators for the preparation of training text: secrets, quality, mixing, tokens, personal data, URLs, copies, search."""
