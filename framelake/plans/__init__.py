"""Parameter tables and the geometry / encoding plans derived from them."""
