"""tunedata: translation-memory bitext, splits, SFT tokenisation, batch inference and
corpus BLEU as Spark DataFrame transformations."""

__version__ = "0.1.0"
