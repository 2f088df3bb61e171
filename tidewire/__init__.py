"""tidewire: signal-feed analytics as plain Spark DataFrame functions."""
