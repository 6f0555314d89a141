"""Streams: state that the transforms can't express, and the jobs."""
