"""Byte codecs in plain Python and numpy: no Spark here."""
