"""Plans that join operators: checkpoints, stores, ingest and retrieval."""
