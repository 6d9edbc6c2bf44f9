"""DataFrame → DataFrame operators: bitext shaping, splits, SFT tokenisation, inference, metrics."""
