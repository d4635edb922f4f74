"""Where statements come from: relational tables and message envelopes."""
