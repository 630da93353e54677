"""Part of Quarry; see the README for what lives where."""
