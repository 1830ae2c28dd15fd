"""quillon: DataFrame operators for judging how well series, vectors and texts align, at cluster scale."""

__version__ = "0.1.0"
