"""Training-data operators: toxicity, licences, packing, deduplication, PII,
chat formatting, quality scoring and decontamination, each a DataFrame ->
DataFrame function.  Nothing else in the library imports this subpackage."""
