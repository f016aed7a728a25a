"""Training-data operators: quality, language, dedup, search, licences, leaks,
extraction, tokens, joins and toxicity.  Nothing else in the library imports
this subpackage."""
