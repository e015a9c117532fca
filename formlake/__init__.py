"""Race-form features, audits, models and card scoring as Spark plans."""

__version__ = "0.1.0"
