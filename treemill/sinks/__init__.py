"""Writers: documents, tables, checkpoints, manifests, trackers."""
