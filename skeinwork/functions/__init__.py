"""Part of Skeinwork."""
