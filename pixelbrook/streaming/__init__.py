"""Structured Streaming: new files probed as they arrive, and animations composed frame by frame with bounded state."""
