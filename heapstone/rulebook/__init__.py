"""Rule tables: thresholds as SQL on summary columns, evaluated by ``heapstone.operators.rules``."""
