"""Training-data operators: dedup, decontamination, joins, chat, packing, shards, records, lengths, toxicity, licences.

Nothing outside this subpackage imports it.  Queries and their SQL are in
``queries.py``; the corpus pipeline is ``corpus_pipeline.py`` at the
repository's top.
"""
