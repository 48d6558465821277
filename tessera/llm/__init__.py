"""Training-data operators: one module per operator, queries in :mod:`tessera.llm.queries`."""
