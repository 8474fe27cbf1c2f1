"""Training-data operators: packing, archives, decontamination, deduplication, scoring and scanning of documents."""
