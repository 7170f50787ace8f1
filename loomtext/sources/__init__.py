"""Engine sources."""
