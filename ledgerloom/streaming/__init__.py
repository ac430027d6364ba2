"""Structured Streaming over the same operators; an extension, for the feeds are monthly batches."""
