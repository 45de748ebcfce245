"""Call analytics on Spark tables: segments, turns, speaker vectors, frames, phrases."""
