"""sedimenta: a PySpark-native engine for memory vaults and the texts in them."""

__version__ = "0.1.0"
