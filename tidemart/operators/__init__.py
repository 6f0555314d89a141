"""Transforms: DataFrames in, DataFrames out; no input, output or actions. Those without a word on it serve batch and streams alike."""
