"""Operators for preparing large text corpora: near-duplicates, language, quality, tokens,
secrets, licences, toxicity and benchmark overlap. Nothing outside this subpackage imports it."""
