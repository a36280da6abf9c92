"""Column functions; everything here works on batch and streaming frames alike."""
