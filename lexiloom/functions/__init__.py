"""Column expressions: text cleaning, identity keys, similarity and time."""
