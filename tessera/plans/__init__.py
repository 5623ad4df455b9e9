"""Planning of fusion jobs."""
