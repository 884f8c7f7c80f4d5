"""Writers of outputs, checkpoints and notices."""
