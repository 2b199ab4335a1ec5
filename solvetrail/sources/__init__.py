"""Reading landed payloads, reading and writing result tables."""
