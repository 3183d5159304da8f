"""Part of targetlake."""
