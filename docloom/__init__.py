"""Document analytics on Spark: ingest, extract, chunk, retrieve, pack, analyse, evaluate."""
