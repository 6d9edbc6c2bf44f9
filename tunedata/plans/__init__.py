"""Composed plans: the distributed exact rank, the test corpus, the registered queries and their oracles."""
