"""Column-level functions: keys, packets, vectors, scores, alerts, times."""
