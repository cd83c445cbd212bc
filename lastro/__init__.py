"""lastro: land delimited text and Brazilian fiscal XML as clean, keyed Spark tables."""

__version__ = "0.1.0"
