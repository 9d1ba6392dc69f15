"""Session, table and model-run input and output."""
