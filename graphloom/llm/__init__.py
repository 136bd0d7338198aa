"""Training-data operators: dedup, cleaning, scoring, mixing and packing of documents."""
