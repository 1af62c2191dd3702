"""Training-data operators: text in, decisions, spans, packs and scores out."""
