"""varloom: DataFrame operators for paired tumor/normal variant tables and the corpora around them."""

__version__ = "0.1.0"
