"""Operators that prepare training text: token ids, mixtures, containers, pieces, repair of wrongly decoded text."""
