"""Operators for preparing training corpora: text rules, duplicates, extraction, tokenizing, privacy, chat."""
