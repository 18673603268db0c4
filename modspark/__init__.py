"""modspark: chat-safety data operators as Spark plans."""

__version__ = "0.1.0"
