"""Training-data operators: one module per operator, one query registry (:mod:`.queries`)."""
