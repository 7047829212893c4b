"""riskframe: DataFrame operators for imbalanced binary classification of companies."""

__version__ = "0.1.0"
