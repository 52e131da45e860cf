"""Corpus operators for training data: packing, near and exact duplicates,
secrets, chat formatting, main text, BPE, language, line quality and repeated
passages. Nothing outside this subpackage imports it."""
