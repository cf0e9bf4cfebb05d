"""Tables that are written: versions, upserts, synchronisation."""
