"""Quarry: an evidence analytics engine expressed as Spark plans."""
