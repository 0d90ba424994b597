"""Jobs (train / eval / predict / profile) and the registered query catalog."""
