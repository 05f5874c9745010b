"""Stream-static joins."""
